"""Packing: every id once, and BM25 scores and the order of neighbours against plain loops."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from bandloom.llm import packing

RND = random.Random(3)
TEXTS = [None, "", " ", "a  b\n\n c <|endoftext|>x", "long " * 900] + [" ".join(RND.choices(["the", "Of", "thing", "don't", "über", "漢字", "a1b2", "..."], k=RND.randint(1, 60))) for _ in range(40)]


@pytest.mark.parametrize("shard_tokens", [64, 1 << 19])
def test_each_id_lies_in_one_piece(spark, shard_tokens):
    """Null and repeated ids, repeated rows, null, empty and long texts, columns with clashing names."""
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], 1, "x"), (None, "no id", 1, "x"), (None, "no id", 1, "x"), (None, "other", 1, "x")]
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    df = spark.createDataFrame(rows, "doc_id long, text string, row long, ids string").repartition(3)
    got, sequences, seen = packing.pack(df, window=256, shard_tokens=shard_tokens).collect(), {}, Counter()
    whole = {(i, len(e) + 1): [*e, 2] for i, t, *_ in rows for e in [lib.encode(t or "", add_special_tokens=False).ids]}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id is not None:
            part = np.array(whole[r.doc_id, r.doc_tokens][r.start : r.start + r.length], "<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.length == len(part)
        seen.update((r.doc_id, r.doc_tokens, k) for k in range(r.start, r.start + r.length))
    want = Counter((i, len(lib.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, *_ in rows)
    assert seen == {(i, n, k): count for (i, n), count in want.items() for k in range(n)}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256 and at & (at - 1) == 0
    assert packing.pack(df.limit(0)).count() == 0


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    return [rng.integers(0, 30, rng.integers(1, 40)).astype("<u2") for _ in range(n)]


def bm25(docs, df, n, mean, seed, i):
    tf, total = Counter(docs[i].tolist()), 0.0
    for t in set(docs[seed].tolist()):
        if t in tf:
            idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
            total += idf * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean))
    return total


def test_scores_and_order_equal_plain_loops():
    """The index over one shard, with statistics of a larger table; greedy filling by score, then number."""
    docs, elsewhere = corpus(40, 1), corpus(25, 2)
    df = Counter(t for d in [*docs, *elsewhere] for t in set(d.tolist()))
    n, mean = 65, sum(map(len, [*docs, *elsewhere])) / 65
    idf = packing.inverse_frequency(np.array([df[t] for t in range(30)]), n)
    index = packing.ShardIndex(docs, idf, mean)
    for seed in range(40):
        assert index.scores(seed) == pytest.approx([bm25(docs, df, n, mean, seed, i) for i in range(40)])
    left, start, want = [len(d) for d in docs], [0] * 40, []
    for seed in range(40):
        while left[seed]:
            order = sorted((i for i in range(40) if left[i] and i != seed), key=lambda i: (-round(bm25(docs, df, n, mean, seed, i), 9), i))
            room, parts = 64, []
            for i in [seed, *order]:
                size = min(room, left[i])
                if size:
                    parts.append((i, start[i], size))
                    start[i] += size
                    left[i] -= size
                    room -= size
            want.append(parts if not room else None)
    got = packing.fill_windows(docs, 64, idf, mean)
    full = [p for p in want if p]
    assert [list(map(tuple, p)) for p in got][: len(full)] == full
    assert sum(size for p in got for *_, size in p) == sum(map(len, docs))


def test_likely_neighbours_share_a_shard():
    """Documents of two topics are sorted apart by their minwise terms."""
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 20, 60) + 100 * (i % 2) for i in range(200)]
    keys = packing._minwise_terms(docs, np.ones(130))
    order = sorted(range(200), key=lambda i: tuple(keys[i]))
    together = sum(a % 2 == b % 2 for a, b in zip(order, order[1:]))
    assert together > 150
