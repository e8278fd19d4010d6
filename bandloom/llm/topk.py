"""Exact top-k by inner product with block-at-a-time pruning.

Candidates are cut, where they lie, into blocks of vec_id ranges. Per dimension a block knows its
greatest and least value, whose sum of products bounds every score in it. A query visits blocks from
the greatest bound down and stops when a bound falls below its k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chunks
from .common import stored

EXACT = float(1 << 53)


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and floor(scale * x) of each component, without vectors that are null or hold null or non-finite components."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(sound).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v")
    )


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of int64, shorter vectors filled with zeros."""
    out = np.zeros((len(column), width), np.int64)
    at = 0
    for part in column.chunks:
        values, sizes = part.flatten().to_numpy(), np.diff(part.offsets.to_numpy())
        rows = np.repeat(np.arange(len(sizes)), sizes)
        out[at + rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
        at += len(sizes)
    return out


def _width(*columns: pa.ChunkedArray) -> int:
    return max([1, *(int(np.diff(p.offsets.to_numpy()).max(initial=0)) for c in columns for p in c.chunks)])


def _suits_floats(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether no sum of products can leave the integers that doubles hold exactly."""
    top = lambda m: float(np.abs(m.astype(np.float64)).max(initial=0))
    return top(a) * top(b) * a.shape[1] < EXACT


class Best:
    """The k best candidates of each query so far, equal scores by smaller vec_id, and the share of blocks that were scored."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray | None = None):
        self.queries, self.ids, self.k = queries, ids, k
        self.least = np.full(len(ids), -np.inf, object) if least is None else least.astype(object)  # what a candidate must reach
        self.found: list[list[np.ndarray]] = [[np.array([], np.int64), np.array([], object)] for _ in ids]
        self.scored = self.met = 0

    def search(self, vectors: np.ndarray, ids: np.ndarray, block: int) -> None:
        """Meet these vectors by blocks of vec_id ranges, for each query from the greatest bound down."""
        order = np.argsort(ids, kind="stable")
        kind = np.float64 if _suits_floats(self.queries, vectors) else object  # object: Python's exact integers
        q, x, ids = self.queries.astype(kind), vectors[order].astype(kind), ids[order]
        least = self.least if kind is object else self.least.astype(np.float64)
        begins = np.arange(0, len(x), block)
        high, low = np.maximum.reduceat(x, begins), np.minimum.reduceat(x, begins)
        bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        visit = np.argsort(-bounds, axis=1, kind="stable")
        alive = np.arange(len(q))
        self.met += bounds.size
        for turn in range(len(begins)):
            alive = alive[bounds[alive, visit[alive, turn]] >= least[alive]]
            if not len(alive):
                break
            self.scored += len(alive)
            goes = visit[alive, turn]
            for b in np.unique(goes):
                own, rows = alive[goes == b], slice(begins[b], begins[b] + block)
                scores = q[own] @ x[rows].T
                takes = (scores >= least[own][:, None]) & (ids[rows][None, :] != self.ids[own][:, None])
                for n in np.flatnonzero(takes.any(1)):
                    i, take = own[n], np.flatnonzero(takes[n])
                    who, what = np.concatenate([self.found[i][0], ids[rows][take]]), np.concatenate([self.found[i][1], scores[n, take]])
                    top = np.lexsort((who, -what))[: self.k]
                    self.found[i] = [who[top], what[top]]
                    if len(top) == self.k:
                        least[i] = max(least[i], what[top[-1]])
        self.least = least.astype(object)

    def table(self) -> pa.Table:
        sizes = [len(f[0]) for f in self.found]
        held = [max(-(1 << 63), min((1 << 63) - 1, int(s))) for f in self.found for s in f[1]]
        vec = np.concatenate([np.array([], np.int64), *(f[0] for f in self.found)])
        return pa.table({"query_id": pa.array(np.repeat(self.ids, sizes), pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(held, pa.int64())})


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, lot_values: int = 1 << 21, block: int = 32, first: int = 16, counted: tuple[Accumulator, Accumulator] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose vec_id is divisible by every.

    Equal scores go to the smaller vec_id; rows that share a vec_id are one, with the least of their
    vectors; a shorter vector counts as if filled with zeros; null vec_id and unsound vectors take no
    part; scores beyond 64 bits are held at its ends, in no order among themselves; other columns
    are ignored; no rows give no rows. Queries are broadcast in lots of about lot_values components,
    each lot against all rows where they lie; only what each task finds best is shuffled. The k-th
    scores of a first part of the rows (one in first, by hash) bound from below what the rest must reach. Rows are dealt
    by ranges of vec_id, so a task's blocks are ranges too, however many tasks there are. counted: accumulators of the
    pairs of query and block that were scored and met.
    """
    spark = vectors.sparkSession
    one_an_id = integer_vectors(vectors, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    whole = stored(one_an_id.repartitionByRange("vec_id").sortWithinPartitions("vec_id"))
    asked = whole.filter(F.col("vec_id") % every == 0)
    n_asked, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    lots = max(1, -(-n_asked * max(1, width) // lot_values))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def nearest(rows: DataFrame, lot: pa.Table, least: np.ndarray | None) -> DataFrame:
        ids, column = lot.column("vec_id").to_numpy(), lot.column("v")
        sent = spark.sparkContext.broadcast((_matrix(column, _width(column)), ids, least))  # a lot is bounded

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunks.hold("topk")
            queries, query_ids, bound = sent.value
            found = Best(queries, query_ids, k, bound)
            for batch in batches:
                column = pa.chunked_array([batch.column("v")])
                wide = max(_width(column), queries.shape[1])
                found.queries = np.pad(queries, ((0, 0), (0, wide - queries.shape[1])))
                if batch.num_rows and len(query_ids):
                    found.search(_matrix(column, wide), batch.column("vec_id").to_numpy(), block)
            if counted:
                counted[0].add(found.scored)
                counted[1].add(found.met)
            yield from found.table().to_batches()

        return rows.mapInArrow(run, "query_id long, vec_id long, score long")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    in_first = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(first)) == 0
    parts = []
    for number in range(lots):
        lot = asked.filter(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(lots)) == number).toArrow()
        early = stored(ranked(nearest(whole.filter(in_first), lot, None)))
        kth = {r.query_id: r.score for r in early.filter(F.col("rank") == k).collect()}
        held = (1 << 63) - 1
        least = np.array([-np.inf if abs(kth.get(i, held)) >= held else kth[i] for i in lot.column("vec_id").to_pylist()], object)
        parts.append(early.drop("rank").unionByName(nearest(whole.filter(~in_first), lot, least)))
    return ranked(reduce(DataFrame.unionByName, parts)).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
WITH sound AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM sound q JOIN sound c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
