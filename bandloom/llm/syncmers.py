"""Document fingerprints from closed syncmers.

A k-mer of code points is chosen when the least hash among its inner s-mers lies at its first or
last place. The choice looks at the k-mer alone, so equal passages choose equal anchors wherever
they stand. A fingerprint keeps a share of the anchors, by hash, with their places; two fingerprints are
matched by equal anchors whose places agree with those of their neighbours.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks
from .common import whole_text

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LAST_ID = (1 << 63) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def closed_syncmers(text: str, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the chosen k-mers; the text is framed by k - 1 zeros, so short texts have some too."""
    code = np.frombuffer(("\0" * (k - 1) + text + "\0" * (k - 1)).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    inner = code[: len(code) - s + 1] * _M1
    for j in range(1, s):
        inner = (inner + code[j : len(code) - s + 1 + j]) * _M1
    inner = _mix(inner)
    width = k - s + 1
    least, have = inner, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[width - 1 :] == least))
    whole = inner[at]
    for j in [*range(s, width - 1, s), width - 1]:  # s-mers that cover the k-mer
        whole = whole * _M1 + inner[at + j]
    return _mix(whole), at


def fingerprint(text: str, k: int, s: int, least: int, finest: int) -> tuple[int, np.ndarray]:
    """A level and the text's distinct anchors at it: columns hash (32 bits) and first place, by hash.

    At level l the anchors with hashes in the lowest 2 ** -l of all are kept. The level is the highest,
    up to finest, that keeps least anchors, so their number follows the length of a long text.
    """
    hashes, at = closed_syncmers(text, k, s)
    hashes = (hashes >> np.uint64(32)).astype(np.uint32)
    for level in range(finest, -1, -1):
        low = np.flatnonzero(hashes <= np.uint32(0xFFFFFFFF >> level))
        kept, first = np.unique(hashes[low], return_index=True)
        if len(kept) >= least or not level:
            break
    return level, np.stack([kept, at[low[first]].astype(np.uint32)], 1).astype("<u4")


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray], chars_a: int, chars_b: int, slack: int = 32) -> float:
    """Share of anchors in common at consistent places, 0 to 1.

    Both are brought to the higher level. An anchor of both counts if the shift between its places is
    that of a neighbouring common anchor, or of the texts' starts or ends, within slack characters: a
    passage counts wherever it stands, an anchor that both hold by chance does not.
    """
    level = max(a[0], b[0])
    (hash_a, place_a), (hash_b, place_b) = (f[1][f[1][:, 0] <= np.uint32(0xFFFFFFFF >> level)].T for f in (a, b))
    if not len(hash_a) + len(hash_b):
        return 0.0
    common, in_a, in_b = np.intersect1d(hash_a, hash_b, assume_unique=True, return_indices=True)
    order = np.argsort(place_a[in_a], kind="stable")
    shift = place_b[in_b][order].astype(np.int64) - place_a[in_a][order].astype(np.int64)
    near = np.abs(np.diff(shift)) <= slack
    fits = np.zeros(len(common), bool)
    fits[1:] |= near
    fits[:-1] |= near
    if len(common):
        fits[0] |= abs(shift[0]) <= slack
        fits[-1] |= abs(shift[-1] - (chars_b - chars_a)) <= slack
    return 2 * int(fits.sum()) / (len(hash_a) + len(hash_b))


def edit(text: str, following: str) -> str:
    """text with its last quarter replaced by as many code points from the start of the following text."""
    tail = len(text) // 4
    return text[: len(text) - tail] + following[:tail]


def successors(texts: DataFrame, bytes_per_range: int = 64 << 20) -> DataFrame:
    """Rows of doc_id and text dealt by ranges of doc_id and sorted, each range closed by a copy of the next range's first row.

    The last range is closed by the first row of all. A copy has closing = 1. The texts are
    shuffled once; only the first id of each range comes to the driver. Rows of one doc_id share a
    range, whose task reads them as a sorted stream and holds two texts at a time.
    """
    spark = texts.sparkSession
    keyed = texts.withColumn("place", F.coalesce("doc_id", F.lit(LAST_ID)))
    total = keyed.agg(F.sum(F.octet_length("text").cast("long"))).first()[0]
    if total is None:
        return keyed.withColumns({"range": F.lit(0), "closing": F.lit(0)})
    n = max(1, -(-total // bytes_per_range))
    splits = np.unique(np.array(keyed.select(F.col("place").cast("double").alias("place")).approxQuantile("place", [i / n for i in range(1, n)], max(1e-5, 1 / (8 * n)))).astype(np.int64)) if n > 1 else np.zeros(0, np.int64)
    sent = spark.sparkContext.broadcast(splits)  # one number a range

    @F.pandas_udf("int")
    def range_of(places: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(sent.value, places.to_numpy(), side="right").astype(np.int32))

    ranged = keyed.withColumn("range", range_of("place"))
    firsts = [tuple(r) for r in ranged.groupBy("range").agg(F.min("place")).sort("range").collect()]
    number = {r: i for i, (r, _) in enumerate(firsts)}
    closing = spark.createDataFrame([(place, firsts[i - 1][0]) for i, (_, place) in enumerate(firsts)], "place long, range int")  # one row a range
    copies = keyed.join(F.broadcast(closing), "place").withColumn("closing", F.lit(1))
    both = ranged.withColumn("closing", F.lit(0)).select("doc_id", "text", "place", "range", "closing").unionByName(copies)
    return both.repartitionById(max(number) + 1, "range").sortWithinPartitions("range", "closing", "place", "text")


def fingerprint_documents(docs: DataFrame, k: int = 12, s: int = 5, least: int = 64, finest: int = 4) -> DataFrame:
    """Fingerprints of every text and of its edit by the next document's start, and their likeness.

    A fingerprint is the base64 of its level (one byte) and of its anchors' hashes and places (pairs of
    little-endian 32 bits). The next document is that of the next doc_id, after the last the first; a null
    doc_id comes last, and rows of equal doc_id go by text. A null text is empty and has the one
    fingerprint of an empty text; a very long text is read whole and keeps one anchor for each 64
    characters in the mean. Equal texts have equal fingerprints. Other columns are ignored; no rows
    give no rows.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def shown(f: tuple[int, np.ndarray]) -> str:
        return base64.b64encode(bytes([f[0]]) + f[1].tobytes()).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks.hold("syncmers")
        last = None  # the row that waits for its next one: range, doc_id, text, fingerprint
        for batch in batches:
            for begin, stop in chunks.byte_ranges(batch.column("text"), 4 << 20):
                rows = []
                for number, closing, doc_id, text in zip(*(batch.column(c)[begin:stop].to_pylist() for c in ("range", "closing", "doc_id", "text")), strict=True):
                    if closing and (last is None or last[0] != number):
                        continue  # a further copy of equal doc_id
                    own = fingerprint(text, k, s, least, finest)
                    if last is not None and last[0] == number:
                        changed = edit(last[2], text)
                        edited = fingerprint(changed, k, s, least, finest)
                        near = likeness(last[3], edited, len(last[2]), len(changed)), likeness(last[3], own, len(last[2]), len(text))
                        rows.append((last[1], len(last[2]), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), shown(last[3]), shown(edited), *near))
                    last = None if closing else (number, doc_id, text, own)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return successors(whole_text(docs)).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
