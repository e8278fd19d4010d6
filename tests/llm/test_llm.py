"""The training-data operators against brute force, exact round trips and held-out accuracy, on small tables."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from bandloom.llm import bpe, chunks, components, hosts, language, neardup, sharding, syncmers, token_counts, topk, toxicity

RND = random.Random(5)
WORDS = ["the", "Of", "thing", "don't", "über", "naïve,", "漢字", "a1b2", "x" * 40, "...", "İ", "<|endoftext|>", "É!", "ﬁn"]
TEXTS = [None, "", " ", "a  b\n\n c <|endoftext|>x", "'s 're don'T", "long " * 3000, "漢" * 500] + [" ".join(RND.choices(WORDS, k=RND.randint(1, 60))) for _ in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, a repeated row, a null id, and columns whose names clash with results."""
    rows = [(i, t, "en" if i % 2 else None, i, "x") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "en", 5, "x"), (None, "no id here", None, 0, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score long, shard string").repartition(3).cache()


def rows_of(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


def tokenizer(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def test_bpe_equals_the_library(docs):
    lib, sha = tokenizer("word_bpe_49k.json"), lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = rows_of(bpe.encode_decode(docs))
    assert len(got) == len(TEXTS) + 2
    for row in got[:-1]:
        ids = lib.encode(TEXTS[row["doc_id"]] or "", add_special_tokens=False).ids
        assert (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))


def test_token_counts_equal_the_library(docs):
    lib = tokenizer("byte_bpe_50k.json")
    for row in rows_of(token_counts.count_tokens(docs))[:-1]:
        text = TEXTS[row["doc_id"]] or ""
        n = len(lib.encode(text, add_special_tokens=False).ids)
        assert (row["n_bytes"], row["n_tokens"], row["over_limit"]) == (len(text.encode()), n, n > 1024)


def test_pieces_are_safe_cuts():
    lib = tokenizer("byte_bpe_50k.json")
    for _ in range(300):
        text = "".join(RND.choices("ab1 ' \n\té漢 .!\x85\x1c", k=30))
        assert "".join(chunks.spaced_pieces(text)) == text
        assert sum(len(lib.encode(p, add_special_tokens=False).ids) for p in chunks.spaced_pieces(text)) == len(lib.encode(text, add_special_tokens=False).ids)


def test_syncmers(docs, spark):
    """The null id last, rows of one id by text, hashes and counts; ranges of a few bytes give the same rows."""
    got = syncmers.fingerprint_documents(docs).collect()
    texts = [(i, t or "") for i, t in enumerate(TEXTS)]
    texts = sorted([*texts, (5, TEXTS[5])]) + [(None, "no id here")]
    want = []
    for n, (i, t) in enumerate(texts):
        edited = syncmers.edit(t, texts[(n + 1) % len(texts)][1])
        assert edited == t[: len(t) - len(t) // 4] + texts[(n + 1) % len(texts)][1][: len(t) // 4]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(map(str, [tuple(r)[:3] for r in got])) == sorted(map(str, want))
    assert all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in got)
    by_text = {}
    for r in got:
        if r.doc_id is not None:
            by_text.setdefault(TEXTS[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    ranged = syncmers.successors(syncmers.whole_text(docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])), bytes_per_range=500)
    assert ranged.filter("closing = 1").count() == ranged.select("range").distinct().count() > 5
    assert not syncmers.fingerprint_documents(docs.limit(0)).count()


def plain_syncmers(text, k, s):
    """k-mers of the framed text whose least s-mer hash stands first or last, by a loop."""
    framed = "\0" * (k - 1) + text + "\0" * (k - 1)

    def hashed(part):
        x = 0
        for n, c in enumerate(part):
            x = ord(c) if not n else (x + ord(c)) % (1 << 64)
            x = x * 0x9E3779B97F4A7C15 % (1 << 64)
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % (1 << 64)
        return x ^ (x >> 31)

    out = []
    for at in range(len(framed) - k + 1):
        inner = [hashed(framed[at + j : at + j + s]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((at, framed[at : at + k]))
    return out


def test_chosen_kmers_equal_a_plain_loop():
    for text in ("", "a", "the thing über 漢字 and the thing", "".join(RND.choices("abcd ", k=400))):
        hashes, at = syncmers.closed_syncmers(text, 12, 5)
        want = plain_syncmers(text, 12, 5)
        assert at.tolist() == [p for p, _ in want]
        kmers = {}
        for h, (_, kmer) in zip(hashes.tolist(), want):
            assert kmers.setdefault(kmer, h) == h
        assert len(set(kmers.values())) == len(kmers)


def prose(n):
    return " ".join("".join(RND.choices("abcdefghijklmnop", k=6)) for _ in range(n))


def near(a, b):
    return syncmers.likeness(syncmers.fingerprint(a, 12, 5, 64, 4), syncmers.fingerprint(b, 12, 5, 64, 4), len(a), len(b))


def test_likeness_follows_the_text_in_common():
    text, other = prose(3000), prose(3000)
    assert near(text, text) == 1 and near(text, other) == 0 and near("", "") == 1 and near("ab", "ab") == 1 and near("", text) < 0.05
    assert abs(near(text, text[: len(text) * 3 // 4]) - 2 * 0.75 / 1.75) < 0.05
    assert abs(near(text, text[9000:] + text[:9000]) - 1) < 0.05  # moved passages
    assert near(text, " ".join(sorted(text.split()))) < 0.1  # the same words in another order
    passage = prose(60)
    assert 0 < near(other + " " + passage, prose(3000) + passage) < 0.1  # a passage of 60 words in two long texts
    assert len(syncmers.fingerprint(prose(30_000), 12, 5, 64, 4)[1]) > 8 * len(syncmers.fingerprint(text, 12, 5, 64, 4)[1])


@pytest.mark.parametrize(("scale", "lot_values"), [(1, 1 << 21), (1, 12), (1 << 14, 12)])
def test_top_k_equals_brute_force(spark, scale, lot_values):
    """Repeated rows, repeated ids with other vectors, ties, shorter vectors, nulls, a clashing column."""
    rng = np.random.default_rng(1)
    vectors = {i: [float(x) * scale for x in rng.integers(-3, 4, 6 - (i == 7)) / 2] for i in range(0, 700, 7)}
    rows = [*vectors.items(), (0, vectors[0]), (7, vectors[7]), (14, [9.0 * scale] * 6), (350, [9.0 * scale] * 6), (800, None), (900, [1.0, None]), (1000, [float("nan")]), (None, [1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    ints = {i: [int(np.floor(1024 * x)) for x in v] for i, v in vectors.items()}
    got = [((r.query_id, r["rank"]), (r.vec_id, r.score)) for r in topk.top_k(df, lot_values=lot_values, block=4, first=3).collect()]
    want = {}
    for q in (i for i in ints if i % 100 == 0):
        order = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:10]
        want |= {(q, r): (i, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, i) in enumerate(order, 1)}
    assert dict(got) == want and len(got) == len(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_blocks_far_from_a_query_are_not_scored():
    rng = np.random.default_rng(2)
    centres = rng.integers(-900, 900, (20, 16))
    vectors = np.concatenate([c + rng.integers(-30, 30, (64, 16)) for c in centres])
    best = topk.Best(vectors[::100], np.arange(len(vectors))[::100], 10)
    best.search(vectors, np.arange(len(vectors)), 32)
    assert best.scored < 0.3 * best.met
    scores = vectors[::100] @ vectors.T
    for n, (who, what) in enumerate(best.found):
        order = np.lexsort((np.arange(len(vectors)), -scores[n]))
        order = order[order != 100 * n][:10]
        assert who.tolist() == order.tolist() and [int(x) for x in what] == scores[n, order].tolist()


def test_few_blocks_are_scored_in_many_tasks(spark):
    """On vectors whose neighbours in vec_id are alike, however the rows come and however many tasks there are."""
    rng, sc = np.random.default_rng(4), spark.sparkContext
    centres = rng.integers(-900, 900, (40, 16))
    vectors = np.concatenate([c + rng.integers(-30, 30, (128, 16)) for c in centres]) / 1024
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        counted = sc.accumulator(0), sc.accumulator(0)
        got = topk.top_k(rows, counted=counted).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert counted[0].value < 0.3 * counted[1].value
    whole = np.floor(1024 * vectors).astype(np.int64)
    scores = whole[::100] @ whole.T
    for n in range(len(scores)):
        order = np.lexsort((np.arange(len(whole)), -scores[n]))
        order = order[order != 100 * n][:10]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == 100 * n), key=lambda r: r.rank)] == list(zip(order.tolist(), scores[n, order].tolist(), strict=True))


def test_posteriors_equal_a_plain_recursion():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 64, 65, 200])
    emissions, transitions = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=(3, 3))
    got, at = language.posteriors(emissions, lengths, transitions), 0
    for n in lengths:
        e, m, a, forward = np.exp(emissions[at : at + n]), np.exp(transitions), np.full(3, 1 / 3), []
        for t in range(n):
            a = (a @ m) * e[t]
            a /= a.sum()
            forward.append(a)
        b = np.ones(3)
        for t in reversed(range(n)):
            p = forward[t] * b
            assert np.allclose(got[at + t], p / p.sum())
            b = m @ (e[t] * b)
            b /= b.max()
        at += n


def test_language_labels_whole_texts(spark):
    rows = [(i, " ".join(RND.choices(["the", "and", "thing"] if i % 2 else ["der", "und", "schön"], k=30)), "en" if i % 2 else "de") for i in range(120)]
    df = spark.createDataFrame([*rows, (500, "1 2 3", "en"), (501, None, "de"), (502, "der und schön " * 9 + "the", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(df).collect()}
    assert all(got[i].lang_pred == lang and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, lang in rows)
    assert (got[500].lang_pred, got[501].lang_pred, got[502].lang_pred) == ("und", "und", "de") and got[500].score == 0
    assert {r.doc_id for r in language.keep_identified(df).collect()} == set(got) - {500, 501}
    none = df.withColumn("lang", df.lang.substr(50, 1)).filter("false")
    assert language.identify(none).count() == 0


def test_toxicity_on_held_out_rows(spark):
    noise = ["lorem", "ipsum", "dolor", "sit", "amet", "elit"]
    rows = [(i, " ".join([*RND.choices(noise, k=20), *(["Scum!"] if i % 4 == 0 else [])])) for i in range(400)]
    df = spark.createDataFrame([*rows, (900, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, labels).collect()}
    assert all(got[i].predicted == (i % 4 == 0) for i in range(400)) and 0 <= got[900].score <= 1
    assert {r.doc_id for r in toxicity.keep_clean(df, labels).collect()} == {i for i in range(400) if i % 4} | {900}


def sets(texts, width):
    out = {}
    for i, t in texts:
        words = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()
    return out


def test_near_duplicates_equal_brute_force(spark):
    base = [[f"w{RND.randint(0, 400)}" for _ in range(60)] for _ in range(12)]
    texts = [(i, " ".join(b)) for i, b in enumerate(base)]
    for k in range(300):  # one large group of near copies, small groups, exact copies
        words = list(base[0 if k < 180 else RND.randrange(12)])
        for _ in range(RND.randint(0, 3)):
            words[RND.randrange(60)] = f"x{RND.randint(0, 10**6)}"
        texts.append((100 + k, " ".join(words)))
    texts += [(900, None), (901, ""), (902, "one two"), (903, "One  two"), (904, "three")]
    own = sets(texts, 4)
    root = {i: i for i in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(own)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(own[a] & own[b])
            if both and 100 * both >= 80 * (len(own[a]) + len(own[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in neardup.near_duplicates(df, width=4, small=64).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(own[i]), find(i), find(i) == i) for i in ids}
    assert {r.doc_id for r in neardup.keep_one_of_each(df, width=4).collect()} == {find(i) for i in ids}


def test_isolated_pairs_in_a_templated_crowd(spark):
    """Texts that share a passage (0.6 in likeness to each other) hide pairs of about 0.81 that no pivot is near to."""
    rnd = random.Random(11)
    shared, texts = [f"t{k}" for k in range(150)], []
    for i in range(0, 800, 2):
        own = [f"o{i}-{k}" for k in range(50)]
        texts.append((i, " ".join(shared + own)))
        other = own[: 50 - 20] + [f"p{i}-{k}" for k in range(20)] if i < 240 else [f"q{i}-{k}" for k in range(50)]
        texts.append((i + 1, " ".join(shared + other)))
    rnd.shuffle(texts)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, width=1, small=16).collect()}
    lost = [i for i in range(0, 240, 2) if got[i + 1] != i]
    assert not lost
    assert all(got[i] == i for i, _ in texts if not (i < 240 and i % 2))


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (5, 5)]
    got = {r.vertex: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_host_verdicts(spark):
    link = '<a href="http://Bad.org/x">'
    pages = [(1, "http://good.com/a", '<a href="https://friend.org/">'), (2, "https://friend.org/z?q", None), (3, "HTTP://X.NET/es/1", ""), (4, "http://bad.org/", '<a href=http://x.net/es/>'), (5, None, None), (6, "no host", link), (7, "http://www.example.com/en/?x", None), (8, "http://m.example.com/en/", None), (9, "http://good.com", None), (10, "http://xcom/", None)]
    got = {r.page_id: tuple(r)[1:] for r in hosts.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1] == ("good.com", "/a", "com/", "allow") and got[2] == ("friend.org", "/z", None, "allow") and got[3] == ("x.net", "/es/1", "net/es/", "block")
    assert got[4] == ("bad.org", "/", None, "block") and got[5] == got[6] == ("", "", None, "allow")
    assert got[7][2:] == ("www.example.com/en/", "allow") and got[8][2:] == ("example.com/en/", "block") and got[9] == ("good.com", "", None, "allow") and got[10][2] is None


def plain_pagerank(edges, seeds, rounds):
    hosts_of = {h for e in edges for h in e} | set(seeds)
    degree = {h: sum(a == h for a, _ in edges) for h in hosts_of}
    start = {h: 0.15 * seeds.get(h, 0) / sum(seeds.values()) for h in hosts_of}
    mass = dict(start)
    for _ in range(rounds):
        moved = dict(start)
        for a, b in edges:
            moved[b] += 0.85 * mass[a] / degree[a]
        mass = moved
    return mass


@pytest.mark.parametrize("block_edges", [2, 1000])
def test_propagation_equals_a_plain_loop(spark, block_edges):
    """A random graph over several domains, whole in one block and cut into many, with a hub beyond a block's size."""
    rnd = random.Random(9)
    names = [f"h{i}.d{i % 3}.org" for i in range(12)]
    edges = sorted({(a, b) for a in names for b in rnd.sample(names, 2) if a != b} | {(names[0], b) for b in names[1:]})
    seeds = {names[1]: 2.0, names[5]: 1.0, "alone.org": 1.0}
    rows = [(side, h, w) for side in ("trust", "distrust") for h, w in seeds.items()]
    got = hosts.propagate(spark.createDataFrame(edges, "a string, b string"), spark.createDataFrame(rows, "side string, host string, weight double"), block_edges=block_edges)
    found = {(r.side, r.host): r.mass for r in got.collect()}
    for side, way in (("trust", edges), ("distrust", [(b, a) for a, b in edges])):
        want = plain_pagerank(way, seeds, 200)
        assert {h: m for (s, h), m in found.items() if s == side} == {h: pytest.approx(m, rel=1e-4) for h, m in want.items() if m}


def test_verdicts_of_a_random_graph_equal_a_plain_loop(spark):
    """host_edges, seeds and verdicts by brute force, with repeated pages, nulls and a clashing column."""
    rnd = random.Random(4)
    names = [f"{a}.{b}" for a in ("x", "y.x", "z") for b in ("com", "net", "org", "info")]
    pages = [(i, f"http://{rnd.choice(names)}/{rnd.choice(['es/', 'fr/', 'a'])}", "".join(f'<a href="http://{rnd.choice(names)}/">' for _ in range(rnd.randint(0, 2))), "c") for i in range(40)]
    pages += [pages[0], (None, None, None, "c")]
    rows = hosts.judge(spark.createDataFrame(pages, "page_id long, url string, html string, host string")).collect()
    assert len(rows) == len(pages) and hosts.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    host = {i: u.split("://")[1].split("/")[0] for i, u, *_ in pages if u}
    edges = {(host[i], link.split("://")[1].split("/")[0]) for i, _, html, _ in pages if i is not None for link in html.split('"')[1::2]}
    known = set(host.values()) | {b for _, b in edges}
    for name in known:
        while name.count(".") > 1:
            up = name.split(".", 1)[1]
            edges |= {(name, up), (up, name)}
            name = up
    edges = sorted((a, b) for a, b in edges if a != b)
    seeds = {"allow": {}, "block": {}}
    for r in rows:
        if r.rule:
            seeds[r.verdict][r.host] = seeds[r.verdict].get(r.host, 0) + 1
    trust, distrust = plain_pagerank(edges, seeds["allow"], 300), plain_pagerank([(b, a) for a, b in edges], seeds["block"], 300)
    for r in rows:
        if not r.rule:
            assert r.verdict == ("block" if distrust.get(r.host, 0) > trust.get(r.host, 0) * (1 + 1e-5) else "allow"), r


def test_far_and_faint_hosts_are_judged(spark):
    """Distrust reaches a host 12 links away; each parent domain is a step."""
    chain = [(k, f"http://h{k}.org/", f'<a href="http://h{k + 1}.org/">') for k in range(11)] + [(11, "http://h11.org/", '<a href="http://h12.net/">'), (12, "http://h12.net/es/", None)]
    got = {r.page_id: r.verdict for r in hosts.judge(spark.createDataFrame(chain, "page_id long, url string, html string")).collect()}
    assert set(got.values()) == {"block"}
    relative = [(1, "http://a.org/", "<a HREF = '//b.org/x?y=://z'>"), (2, "http://b.org/", '<a href="//c.net/"> ' + "x " * 200_000), (3, "http://c.net/es/", '<a href="/local"> <p>//d.org/</p>'), (4, None, '<a href="//d.org/">')]
    got = {r.page_id: r.verdict for r in hosts.judge(spark.createDataFrame(relative, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow"}
    deep = spark.createDataFrame([("http://a.blog.x.example.org/", '<a href="http://q.w.y.org/">')], "url string, html string")
    up = {("a.blog.x.example.org", "blog.x.example.org"), ("blog.x.example.org", "x.example.org"), ("x.example.org", "example.org"), ("q.w.y.org", "w.y.org"), ("w.y.org", "y.org")}
    want = up | {(b, a) for a, b in up} | {("a.blog.x.example.org", "q.w.y.org")}
    assert {tuple(r) for r in hosts.host_edges(deep).collect()} == want


def test_shards(docs, spark):
    got = sharding.shard_records(docs, part_rows=1).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = ((TEXTS + ["no id here"])[-1 if r.doc_id is None else r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(text) + 8, zlib.crc32(text), "key") and r.grown_shard in (r.shard, 24)
        key = "null" if r.doc_id is None else str(r.doc_id)
        best = max(range(24), key=lambda s: (int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16), -s))
        assert r.shard == best
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    spread = spark.range(3000).selectExpr("id AS doc_id", "'x' AS text")
    heavy = sharding.shard_records(spread, shards=3, weights=[1, 1, 2]).groupBy("shard").count().collect()
    assert abs({r.shard: r["count"] for r in heavy}[2] - 1500) < 150


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    words = {"en": ["the", "and", "thing", "house"], "de": ["der", "und", "schön", "haus"]}
    rows = [(i, " ".join([*RND.choices(words["en" if i % 2 else "de"], k=25), *(["scum"] * (i % 5 == 0))]), "en" if i % 2 else "de", "s", 1) for i in range(200)]
    rows += [(300, rows[1][1], "en", "s", 1), (301, "12 34", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    packed = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert packed == {i for i in range(200) if i % 5}
