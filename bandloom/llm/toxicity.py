"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate rates and the L1 term leave few weights other than zero; those are broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks
from .common import bound_batches, id_remainder, whole_text
from .language import word_of

SLOTS = 1 << 20
_UNI, _BI, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _hash_pieces(pieces: list[str]) -> list[int]:
    return [zlib.crc32(word_of(p).encode("utf-8", "replace")) for p in pieces]


_pieces = chunks.PieceTable(_hash_pieces)


def text_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """text number and slot of each word, pair of neighbours and pair with one word between."""
    pieces = [text.split() for text in texts]
    _pieces.learn(pieces)
    lengths = np.array([len(p) for p in pieces], np.int64)
    word = np.fromiter((_pieces[w] for p in pieces for w in p), np.uint64, int(lengths.sum()))
    text = np.repeat(np.arange(len(pieces)), lengths)
    slots, owner = [word * _UNI], [text]
    for gap, factor in ((1, _BI), (2, _SKIP)):
        same = text[gap:] == text[:-gap]
        slots.append(((word[:-gap] * factor) ^ (word[gap:] * _UNI + factor))[same] * factor)
        owner.append(text[gap:][same])
    return np.concatenate(owner), (np.concatenate(slots) >> np.uint64(64 - 20)).astype(np.int64)


class SparseModel:
    """bias, and the slots and values of the weights other than zero."""

    def __init__(self, bias: float, slots: np.ndarray, values: np.ndarray):
        self.bias, self.slots, self.values = bias, slots, values

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], alpha: float = 1.5, beta: float = 1.0, l1: float = 3.0, l2: float = 0.1, rounds: int = 2, seed: int = 7) -> SparseModel:
        """FTRL-proximal with a text's distinct features as ones; slot SLOTS is the bias, without L1."""
        if not texts:
            return cls(-35.0, np.zeros(0, np.int32), np.zeros(0, np.float32))
        z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
        penalty = np.full(SLOTS + 1, l1)
        penalty[SLOTS] = 0

        def weight(at: np.ndarray) -> np.ndarray:
            shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - penalty[at], 0)
            return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

        found: list[np.ndarray] = []  # each text's distinct slots, taken a megabyte of text at a time
        for first, last in chunks.by_bytes(texts):
            owner, slot = np.divmod(np.unique(np.dot([SLOTS, 1], text_features(texts[first:last]))), SLOTS)
            found += np.split(slot.astype(np.int32), np.searchsorted(owner, np.arange(1, last - first)))
        _pieces.forget()
        rng = np.random.default_rng(seed)
        for _ in range(rounds):
            for i in rng.permutation(len(texts)):
                at = np.append(found[i], SLOTS)
                w = weight(at)
                g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
                z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
                n[at] += g * g
        w = weight(np.arange(SLOTS + 1))
        kept = np.flatnonzero(w[:SLOTS])
        return cls(float(w[SLOTS]), kept.astype(np.int32), w[kept].astype(np.float32))


class Scorer:
    def __init__(self, model: SparseModel):
        self.bias, self.weights = model.bias, np.zeros(SLOTS, np.float32)
        self.weights[model.slots] = model.values

    def score(self, texts: pa.Array) -> np.ndarray:
        """Score of each text; a null text is empty."""
        out = np.empty(len(texts))
        for begin, end in chunks.byte_ranges(texts):
            owner, slot = text_features([text or "" for text in texts[begin:end].to_pylist()])
            hit = np.flatnonzero(self.weights[slot])
            owner, slot = np.divmod(np.unique(owner[hit] * SLOTS + slot[hit]), SLOTS)
            out[begin:end] = np.bincount(owner, self.weights[slot], end - begin)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -35, 35)))


def train(docs: DataFrame, labels: DataFrame, positives: int = 1500, negatives: int = 3500, longest: int = 20_000, folds: int = 4, held_out: int = 2) -> SparseModel:
    """Fit on at most positives and negatives labelled texts of at most longest characters each.

    The sample takes the least hashes of doc_id, among labelled texts of that length outside the held-out
    fold; rows with a null id or label teach nothing; of contradicting labels the greater counts, and of several
    texts of one doc_id the least, so the driver receives at most positives + negatives rows.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.filter(id_remainder(F.col("doc_id"), folds) != held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    short = whole_text(docs).filter(F.length("text") <= longest)
    known = known.join(short.select("doc_id"), "doc_id", "left_semi")
    order = F.xxhash64("doc_id"), F.col("doc_id")
    sample = known.filter("toxic = 1").orderBy(*order).limit(positives).unionByName(known.filter("toxic <> 1").orderBy(*order).limit(negatives))
    rows = short.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: r.doc_id)
    return SparseModel.fit([r.text for r in rows], [r.toxic for r in rows])


_scorers: dict[str, Scorer] = {}


def _release() -> None:
    _scorers.clear()
    _pieces.forget()


def _scorer(key: str, model) -> Scorer:
    chunks.hold("toxicity", _release)
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(SparseModel(*model.value))
    return _scorers[key]


def _shared(docs: DataFrame, model: SparseModel):
    """The weights other than zero as a broadcast of at most SLOTS entries, and a key for the workers' copies."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.slots, model.values))
    return f"{docs.sparkSession.sparkContext.applicationId}-{sent._jbroadcast.id()}", sent


def score_toxicity(docs: DataFrame, labels: DataFrame, model: SparseModel | None = None, threshold: float = 0.3, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text.

    Null and empty texts get the score of the bias. A null doc_id is not held out. Repeated rows
    each give a row; a very long text is read whole; only texts take part in a score; without
    labels nothing marks a text and every score is 0; no rows give no rows.
    """
    key, sent = _shared(docs, model or train(docs, labels, folds=folds, held_out=held_out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scorer(key, sent).score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    found = whole_text(docs).mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", F.coalesce(id_remainder(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, model: SparseModel | None = None) -> DataFrame:
    """The rows of docs, all columns, that score below threshold.

    Null and empty texts have the score of the bias. Repeated rows and rows without a doc_id are judged each on its
    own text; very long texts are read whole; other columns, whatever their names, are kept as they are; without labels all
    rows stay; no rows give no rows.
    """
    key, sent = _shared(docs, model or train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scorer(key, sent).score(batch.column("text"))
            yield batch.filter(pa.array(scores < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
