"""Lexical retrieval packing: windows filled by a seed document and its BM25 neighbours.

Documents are encoded once and written. Weighted minwise terms deal likely neighbours into the same
shard of bounded size. Each shard holds its own inverted index, with document frequencies and mean
length of the whole table; a seed queries it with all of its terms, and unused neighbours fill the
seed's window in the order of their scores. The neighbour that crosses the window's end is cut there
and its rest stays unused.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks
from .common import stored, whole_text
from .words import WordEncoder

K1, B = 1.2, 0.75
KEYS = 3  # minwise terms by which documents are sorted into shards
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    chunks.hold("packing", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _id_kind(path: str, end_id: int) -> str:
    """The narrowest type that holds every id."""
    most = max(end_id, max(chunks.load_tokenizer(path).get_vocab(with_added_tokens=True).values()))
    return "<u2" if most < 1 << 16 else "<u4"


def encoded(docs: DataFrame, path: str, kind: str, end_id: int) -> DataFrame:
    """row (a number of its own), doc_id, n and ids of every text, end_id included."""
    end = np.array([end_id], kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at = _encoder(path), TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column("text")
            for begin, stop in chunks.byte_ranges(texts, 9 << 20):
                ids, ends = encoder.encode(texts[begin:stop])
                ids = ids.astype(kind)
                starts = np.concatenate([[0], ends[:-1]])
                body = pa.array([ids[b:e].tobytes() + end for b, e in zip(starts, ends, strict=True)], pa.binary())
                rows = pa.array(np.arange(at + begin, at + stop), pa.int64())
                del ids
                chunks.trim()
                yield pa.RecordBatch.from_arrays([rows, batch.column("doc_id")[begin:stop], pa.array(ends - starts + 1, pa.int64()), body], ["row", "doc_id", "n", "ids"])
            at += len(texts)
        chunks.trim()

    return whole_text(docs).mapInArrow(run, "row long, doc_id long, n long, ids binary")


def _distinct_terms(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """document number, term and count of each distinct term of each document, in that order."""
    lengths = np.array([len(d) for d in ids])
    key, count = np.unique((np.repeat(np.arange(len(ids)), lengths) << 32) | np.concatenate(ids).astype(np.int64), return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, count


def _batches(column: pa.Array, kind: str, most: int = 1 << 20) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Where each part of about most bytes begins, and its documents' ids."""
    values = column.to_pylist()
    for begin, stop in chunks.by_bytes(values, most):
        yield begin, [np.frombuffer(v, kind) for v in values[begin:stop]]


def document_frequencies(table: DataFrame, kind: str) -> tuple[np.ndarray, int, float]:
    """How many documents hold each term, over all of the table, how many documents it has and their mean length.

    One row a term and task is shuffled; what comes to the driver is bounded by the vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks.hold("packing", _encoders.clear)
        found, n, total = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            for _, ids in _batches(batch.column("ids"), kind):
                own = np.bincount(_distinct_terms(ids)[1])
                size = max(len(own), len(found))
                found = np.pad(found, (0, size - len(found))) + np.pad(own, (0, size - len(own)))
                n, total = n + len(ids), total + sum(map(len, ids))
        terms = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], terms]), pa.int64()), pa.array(np.concatenate([[n, total], found[terms]]), pa.int64())], ["term", "n"])

    rows = table.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    by_term = {r.term: r.n for r in rows}
    n, total = by_term.pop(-1, 0), by_term.pop(-2, 0)
    out = np.zeros(max(by_term, default=0) + 1, np.int64)
    out[list(by_term)] = list(by_term.values())
    return out, n, total / max(1, n)


def inverse_frequency(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5))


def _minwise_terms(ids: list[np.ndarray], weight: np.ndarray) -> np.ndarray:
    """For each document KEYS of its terms, each the first in a race whose speeds are the terms' weights.

    Two documents share such a term with the probability of their weighted similarity.
    """
    doc, term, count = _distinct_terms(ids)
    speed = weight[term] * count / (count + K1)
    begins = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    out = []
    for k in range(KEYS):
        time = -np.log(np.random.default_rng(k + 1).random(len(weight)))[term] / np.maximum(speed, 1e-12)
        first = time == np.repeat(np.minimum.reduceat(time, begins), np.diff(np.r_[begins, len(doc)]))
        at = np.flatnonzero(first)
        out.append(term[at[np.searchsorted(doc[at], np.arange(len(ids)))]])
    return np.stack(out, 1)


class ShardIndex:
    """Inverted index of one shard's documents: by term the documents that hold it, with their BM25 weights."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        lengths = np.array([len(d) for d in docs])
        doc, term, tf = _distinct_terms(docs)
        self.terms, self.term_start = term, np.searchsorted(doc, np.arange(len(docs) + 1))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / mean_length))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight, self.span = doc[order], weight[order], np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.n = self.held = len(docs)

    def drop(self, unused: np.ndarray) -> None:
        """Leave out the postings of used documents once they are a third."""
        left = int(unused.sum())
        if left < self.held * 2 / 3:
            keep = unused[self.doc]
            self.span = np.concatenate([[0], np.cumsum(keep)])[self.span]
            self.doc, self.weight, self.held = self.doc[keep], self.weight[keep], left

    def scores(self, seed: int) -> np.ndarray:
        """Every unused document's score for all of the seed's terms."""
        own = self.terms[self.term_start[seed] : self.term_start[seed + 1]]
        out, doc, weight = np.zeros(self.n), self.doc, self.weight
        for begin, end in zip(self.span[own].tolist(), self.span[own + 1].tolist(), strict=True):
            out[doc[begin:end]] += weight[begin:end]
        return out


def fill_windows(docs: list[np.ndarray], window: int, idf: np.ndarray, mean_length: float) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length); each id of docs lies in exactly one.

    All are full but those of the last window, which is cut to falling powers of two instead of padded.
    """
    lengths = np.array([len(d) for d in docs])
    start = lengths // window * window
    out = [[(i, s, window)] for i in range(len(docs)) for s in range(0, int(start[i]), window)]
    left = lengths - start
    index = ShardIndex(docs, idf, mean_length) if (left > 0).sum() > 1 else None
    for seed in range(len(docs)):
        while left[seed]:
            room, parts = window, []

            def take(i: int, most: int) -> int:
                size = min(int(left[i]), most)
                parts.append((i, int(start[i]), size))
                start[i] += size
                left[i] -= size
                return size

            room -= take(seed, room)
            rest = np.flatnonzero(left)
            if room and len(rest):
                index.drop(left > 0)
                scores = index.scores(seed)[rest]
                if len(rest) > 512:  # enough of the best for the window, ties at the cut included
                    held = np.flatnonzero(scores >= np.partition(scores, len(rest) - 256)[len(rest) - 256])
                    if left[rest[held]].sum() >= room:
                        rest, scores = rest[held], scores[held]
                rest = rest[np.lexsort((rest, -scores))]
                for i in rest[: int(np.searchsorted(np.cumsum(left[rest]), room)) + 1]:
                    room -= take(int(i), room)
            if not room:
                out.append(parts)
                continue
            total = window - room
            for power in (1 << p for p in range(window.bit_length(), -1, -1) if total >> p & 1):
                sequence, want = [], power
                while want:
                    i, s, size = parts.pop(0)
                    sequence.append((i, s, min(size, want)))
                    if size > want:
                        parts.insert(0, (i, s + want, size - want))
                    want -= sequence[-1][2]
                out.append(sequence)
    return out


def pack(docs: DataFrame, window: int = 4096, end_id: int = 2, tokenizer: str | None = None, shard_tokens: int = 1 << 19, task_tokens: int = 16 << 20) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most window tokens.

    A document is its text's ids and end_id, so a null or empty text is the one id end_id. Repeated
    rows are packed each on its own; a null doc_id stays null; a document longer than the window
    fills sequences alone, and only its rest joins others; equal scores go in the order of doc_id;
    other columns are ignored; no rows give no rows. shard_tokens bounds what an index holds, beyond
    a single longer text. Documents are sorted by their minwise terms and dealt by ranges, so no key
    gathers more than a shard; a range has about task_tokens where that is more parts than the
    session's shuffle partitions.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    kind = _id_kind(path, end_id)
    table = stored(encoded(docs, path, kind, end_id))
    df, n, mean_length = document_frequencies(table, kind)
    idf = inverse_frequency(df, n)
    sent = table.sparkSession.sparkContext.broadcast((idf, np.where(df > 1, idf, 0.0)))  # bounded by the vocabulary
    parts = max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(n * mean_length) // task_tokens + 1)
    names = [f"k{k}" for k in range(KEYS)]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks.hold("packing", _encoders.clear)
        for batch in batches:
            keys = [np.zeros((0, KEYS), np.int64), *(_minwise_terms(ids, sent.value[1]) for _, ids in _batches(batch.column("ids"), kind))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in np.concatenate(keys).T)], [*batch.schema.names, *names])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks.hold("packing", _encoders.clear)
        number = TaskContext.get().partitionId() << 33

        def shard(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal number
            rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
            ids, out = [np.frombuffer(r[2], kind) for r in rows], []
            for sequence in fill_windows(ids, window, *([sent.value[0], mean_length])):
                offset = 0
                for i, start, length in sequence:
                    out.append((rows[i][0], start, length, zlib.crc32(ids[i][start : start + length].astype("<u4").tobytes()), len(ids[i]), number, offset))
                    offset += length
                number += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])

        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "ids", "n")), strict=True):
                held.append(row)
                size += row[3]
                if size >= shard_tokens:
                    yield shard(held)
                    held, size = [], 0
        if held:
            yield shard(held)

    ranged = table.mapInArrow(keyed, "row long, doc_id long, n long, ids binary, " + ", ".join(f"{k} long" for k in names))
    return ranged.repartitionByRange(parts, *names, "row").sortWithinPartitions(*names, "row").mapInArrow(fill, SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
