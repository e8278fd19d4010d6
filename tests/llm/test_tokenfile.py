"""Token files: the round trip, random access, sizes of levels and a run on Spark against the tokenizers library."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from bandloom.llm import tokenfile

RND = random.Random(11)
TEXTS = [None, "", " ", "a  b\n\n c <|endoftext|>x", "long " * 3000] + [" ".join(RND.choices(["the", "Of", "thing", "don't", "über", "漢字", "a1b2", "..."], k=RND.randint(1, 60))) for _ in range(40)]


class Counted(io.BytesIO):
    """Counts the bytes that are read."""

    taken = 0

    def read(self, size=-1):
        out = super().read(size)
        self.taken += len(out)
        return out


def written(docs):
    ids, ends = np.concatenate([d for _, d in docs]), np.cumsum([len(d) for _, d in docs])
    return b"".join(tokenfile.file_bytes([i for i, _ in docs], ids, ends)), ids, ends


@pytest.mark.parametrize("most", [1, 3, 200, 1 << 12, 49_409, 1 << 20])
def test_any_run_of_ids_is_read_alone(most):
    rng = np.random.default_rng(most)
    docs = [(None if k == 3 else k - 5, np.minimum(rng.geometric(8 / most, rng.integers(1, 900)) if most > 8 else rng.integers(0, most, 90), most - 1).astype("<u4")) for k in range(200)]
    data, ids, ends = written(docs)
    found = tokenfile.TokenFile(Counted(data))
    assert found.documents()[0] == [i for i, _ in docs] and (found.documents()[1] == ends).all()
    assert (found.ids(0, len(ids)) == ids).all()
    for place in rng.integers(0, len(ids), 200).tolist():
        assert found.token(place) == ids[place]
        end = int(rng.integers(place, len(ids) + 1))
        assert (found.ids(place, end) == ids[place:end]).all()
    assert len(found.ids(7, 7)) == 0
    with pytest.raises(IndexError):
        found.ids(0, len(ids) + 1)


def test_one_token_takes_a_few_bytes():
    """A look at a token reads a chunk, a count and part of one block for each level, however long the file is."""
    ids = np.random.default_rng(0).zipf(1.3, 400_000).clip(0, 49_000).astype("<u4")
    source = Counted(written([(1, ids)])[0])
    found = tokenfile.TokenFile(source)
    assert len(found.levels) > 1
    for place in (0, 1, 399_999, 123_456):
        before = source.taken
        assert found.token(place) == ids[place]
        assert source.taken - before <= len(found.levels) * (tokenfile.BLOCK // 8 + 8 + 8)


def test_widths_are_the_cheapest():
    """Against every way to split the bits."""
    ids = np.random.default_rng(1).zipf(1.2, 5000).clip(0, 4000)

    def splits(n):
        return [[n]] + [[a, *b] for a in range(1, n) for b in splits(n - a)]

    def cost(widths):
        total, rest = 0, ids
        for k, w in enumerate(widths):
            total += len(rest) * (w + (1 + 64 / tokenfile.BLOCK if k < len(widths) - 1 else 0))
            rest = rest[rest >> w > 0] >> w
        return total

    best = tokenfile.chunk_widths(ids)
    assert cost(best) == pytest.approx(min(map(cost, splits(12))))


def test_a_file_that_is_no_token_file():
    with pytest.raises(ValueError):
        tokenfile.TokenFile(io.BytesIO(bytes(200)))


@pytest.mark.parametrize("file_tokens", [64, 4 << 20])
def test_files_of_a_table(spark, tmp_path, file_tokens):
    """Null and repeated ids, repeated rows, null, empty and long texts, clashing columns; places looked up one by one."""
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], 1, "x"), (None, "no id", 1, "x"), (None, "other", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long, ids string").repartition(3)
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    manifest = tokenfile.write_tokens(df, str(tmp_path), file_tokens=file_tokens).cache()
    got = sorted(tokenfile.read_documents(manifest, piece_bytes=256).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    want = sorted(((i is not None, i or 0, [*lib.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, *_ in rows))
    assert sorted((r.doc_id is not None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    at, whole = 0, []
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
        at += r.n_tokens
        whole += np.frombuffer(r.ids, "<u4").tolist()
    files = manifest.collect()
    assert sum(f.n_tokens for f in files) == at and (len(files) > 20) == (file_tokens == 64)
    places = [0, 7, at - 1, at, None, 7, *RND.choices(range(at), k=50)]
    found = tokenfile.read_tokens(manifest, spark.createDataFrame([(p,) for p in places], "place long"), stride=100).collect()
    assert sorted((r.place is None, r.place, r.token) for r in found) == sorted((p is None, p, whole[p] if p is not None and p < at else None) for p in places)


def test_no_rows(spark, tmp_path):
    manifest = tokenfile.write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path))
    assert tokenfile.read_documents(manifest).count() == manifest.count() == 0


def test_the_registered_query(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lib, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for r, (i, t) in zip(tokenfile.op11_token_files(spark, str(tmp_path)).orderBy("doc_id").collect(), rows, strict=True):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(r) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
