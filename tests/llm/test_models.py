"""The learners against plain loops, and the operators on nulls, repeats, clashing columns and no rows."""

import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from bandloom.llm import bpe, hosts, language, neardup, packing, sharding, syncmers, token_counts, topk, toxicity

RND = random.Random(8)


def plain_features(text):
    """Slots of a text's words, neighbours and pairs with one word between, by a loop."""
    word = [zlib.crc32("".join(c for c in w.lower() if c.isalpha()).encode()) for w in text.split()]
    top = lambda x: (x % (1 << 64)) >> 44
    uni, bi, skip = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
    out = {top(w * uni) for w in word}
    for gap, factor in ((1, bi), (2, skip)):
        for a, b in zip(word, word[gap:]):
            out.add(top((((a * factor) % (1 << 64)) ^ ((b * uni + factor) % (1 << 64))) * factor))
    return out


def test_ftrl_equals_a_plain_loop():
    words = ["aa", "Bb", "c,c", "dd", "ee!"]
    texts = [" ".join(RND.choices(words, k=RND.randint(1, 6))) for _ in range(30)]
    labels = [int("aa" in t) for t in texts]
    for text in texts[:10]:
        assert set(toxicity.text_features([text])[1].tolist()) == plain_features(text)
    alpha, beta, l1, l2 = 1.5, 1.0, 0.2, 0.1
    z, n = {}, {}

    def weight(slot):
        penalty = 0 if slot == "bias" else l1
        value = z.get(slot, 0.0)
        if abs(value) <= penalty:
            return 0.0
        return -(value - math.copysign(penalty, value)) / ((beta + math.sqrt(n.get(slot, 0.0))) / alpha + l2)

    rng = np.random.default_rng(7)
    for _ in range(2):
        for i in rng.permutation(len(texts)):
            slots = [*sorted(plain_features(texts[i])), "bias"]
            before = {s: weight(s) for s in slots}
            g = 1 / (1 + math.exp(-sum(before.values()))) - labels[i]
            for s in slots:
                root = math.sqrt(n.get(s, 0.0))
                n[s] = n.get(s, 0.0) + g * g
                z[s] = z.get(s, 0.0) + g - (math.sqrt(n[s]) - root) / alpha * before[s]
    model = toxicity.SparseModel.fit(texts, labels, l1=l1)
    assert model.bias == pytest.approx(weight("bias"))
    want = {s: weight(s) for s in z if s != "bias" and weight(s)}
    assert dict(zip(model.slots.tolist(), model.values.tolist())) == {s: pytest.approx(w, rel=1e-5) for s, w in want.items()}
    scores = toxicity.Scorer(model).score(pa.array([*texts, None, ""]))
    for text, score in zip([*texts, "", ""], scores):
        assert score == pytest.approx(1 / (1 + math.exp(-model.bias - sum(want.get(s, 0) for s in (plain_features(text) if text else ())))), rel=1e-4)


def test_word_features_equal_a_plain_loop():
    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
        return x ^ (x >> 31)

    words, factor = ["a", "the", "schön", "漢字", "overlong"], 0x9E3779B97F4A7C15
    owner, slots = language.word_features(words)
    for n, w in enumerate(words):
        framed, want = f"^{w}$", [mix(zlib.crc32(w.encode()) * factor % (1 << 64))]
        for size in (2, 3, 4):
            for at in range(len(framed) - size + 1):
                if size == 4 and at not in (0, max(0, len(framed) - 4)):
                    continue  # of four only the affixes
                x = ord(framed[at])
                for c in framed[at + 1 : at + size]:
                    x = (x * factor + ord(c)) % (1 << 64)
                want.append(mix((x + size) * factor % (1 << 64)))
        assert sorted(slots[owner == n].tolist()) == sorted(x % language.SLOTS for x in want), w


def brute(emissions, lengths, transitions):
    """Log of the summed scores, word marginals and pair counts over every labelling of every sequence."""
    n_labels, at, total = len(transitions), 0, 0.0
    marginal, pairs = np.zeros_like(emissions), np.zeros_like(transitions)
    for n in lengths:
        every = list(itertools.product(range(n_labels), repeat=int(n)))
        start = np.exp(transitions) / n_labels  # a label of any kind stands before the first word
        scores = [start[:, ys[0]].sum() * math.exp(sum(emissions[at + t, y] for t, y in enumerate(ys)) + sum(transitions[a, b] for a, b in zip(ys, ys[1:]))) for ys in every]
        total += math.log(sum(scores))
        for ys, s in zip(every, scores):
            for t, y in enumerate(ys):
                marginal[at + t, y] += s / sum(scores)
            pairs[:, ys[0]] += start[:, ys[0]] / start[:, ys[0]].sum() * s / sum(scores)
            for a, b in zip(ys, ys[1:]):
                pairs[a, b] += s / sum(scores)
        at += n
    return marginal, pairs, total


@pytest.mark.parametrize("lot", [2, 4096])
def test_expectations_equal_every_labelling(lot):
    rng = np.random.default_rng(3)
    lengths = np.array([1, 5, 2, 4, 1, 3])
    emissions, transitions = rng.normal(0, 2, (int(lengths.sum()), 3)), rng.normal(0, 1, (3, 3))
    got, want = language.expectations(emissions, lengths, transitions, lot), brute(emissions, lengths, transitions)
    for g, w in zip(got, want):
        assert np.allclose(g, w)
    assert np.allclose(language.posteriors(emissions, lengths, transitions), want[0])
    # The gradient is what is seen less what is expected: held against differences of the likelihood.
    for a in range(3):
        for b in range(3):
            moved = transitions.copy()
            moved[a, b] += 1e-5
            assert (language.expectations(emissions, lengths, moved)[2] - got[2]) / 1e-5 == pytest.approx(got[1][a, b], abs=1e-3)


def test_likelihood_rises_and_separates():
    texts = [" ".join(RND.choices(["the", "and", "thing"] if i % 2 else ["der", "und", "ding"], k=20)) for i in range(40)]
    model = language.WordCRF.fit(texts, ["en" if i % 2 else "de" for i in range(40)])
    assert all(b > a for a, b in zip(model.likelihoods, model.likelihoods[1:])) and model.likelihoods[-1] > -0.2
    start = language.WordCRF.fit(texts, ["en" if i % 2 else "de" for i in range(40)], rounds=0).transitions
    assert np.abs(model.transitions - start).max() > 0.05 and model.transitions[0, 0] > model.transitions[0, 1]
    langs, scores = language.Labeller(model).label(pa.array(["the thing and", "und der ding", "der und the and thing the", None]))
    assert langs == ["en", "de", "en", "und"] and min(scores[:2]) > 0.9 and scores[3] == 0


def test_samples_hold_their_bounds(spark, monkeypatch):
    """An id that repeats thousands of times gives the driver one row."""
    rows = [(1, f"the thing {i} and", "en") for i in range(3000)] + [(i, "der und ding", "de") for i in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = docs.selectExpr("doc_id", "int(doc_id = 1) AS toxic").distinct()
    got, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: got.append(collect(self)) or got[-1])
    model = language.train(docs, per_language=5)
    assert model.labels == ["de", "en"] and sum(map(len, got)) == 6
    assert all(len(words) <= 32 for r in got[0] for words in r.windows)
    got.clear()
    toxicity.train(docs, labels, positives=4, negatives=7)
    assert sum(map(len, got)) <= 8


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, null ids and texts, a long text, and columns named like results and like what operators add."""
    rows = [(1, "the thing and", "en"), (1, "the thing and", "en"), (2, None, "de"), (3, "", None), (None, "der und", "de"), (None, "der und", "de"), (4, "und der " * 20_000, "de"), (8, "der und schön", "de"), (7, "the and the", "en")]
    df = spark.createDataFrame([(*r, 0.5, "x", 1, True, 9) for r in rows], "doc_id long, text string, lang string, score double, node string, row int, kept boolean, held_out int")
    return df.repartition(2).cache()


def test_models_take_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (7, 0, 0), (None, 1, 1)], "doc_id long, toxic int, quality int")
    got = language.identify(odd).collect()
    assert len(got) == 9 and sorted(r.lang_pred for r in got if r.doc_id is None) == ["de", "de"]
    kept = language.keep_identified(odd)
    assert kept.columns == odd.columns and kept.count() == 7
    assert language.keep_identified(odd.withColumn("lang", odd.lang.substr(9, 1)).filter("lang = '?'")).count() == 0
    scored = toxicity.score_toxicity(odd, labels)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"] and scored.count() == 9
    assert toxicity.keep_clean(odd, labels.limit(0)).count() == 9 and toxicity.keep_clean(odd.limit(0), labels).count() == 0


def test_near_duplicates_take_odd_rows(odd):
    got = sorted(neardup.near_duplicates(odd, width=2).collect(), key=str)
    assert len(got) == 9
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].n_shingles == by_id[3].n_shingles == 0 and by_id[2].kept and by_id[3].component_id == 3
    assert [r.kept for r in got if r.doc_id is None].count(True) == 1 and by_id[None].component_id is None
    assert [r.kept for r in got if r.doc_id == 1] == [True, True]
    one = neardup.keep_one_of_each(odd, width=2)
    assert one.columns == odd.columns and sorted(str(r.doc_id) for r in one.collect()) == ["1", "2", "3", "4", "7", "8", "None"]
    assert neardup.near_duplicates(odd.limit(0)).count() == 0 and neardup.keep_one_of_each(odd.limit(0)).count() == 0


def test_no_rows_give_no_rows(spark, odd):
    none, labels = odd.limit(0), spark.createDataFrame([], "doc_id long, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for rows in (bpe.encode_decode(none), token_counts.count_tokens(none), sharding.shard_records(none), packing.pack(none), syncmers.fingerprint_documents(none), language.identify(none), toxicity.score_toxicity(none, labels), hosts.judge(pages), topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"))):
        assert rows.count() == 0


def test_pipeline_takes_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    docs = odd.select("doc_id", "text", "lang").selectExpr("*", "'s' AS source", "1L AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {1, 4, 7, 8, None}
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
