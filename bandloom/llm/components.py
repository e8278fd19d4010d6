"""Connected components of a link table by alternating stars, entirely in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link each vertex's larger (or smaller, and itself) neighbours to its least neighbour."""
    if larger:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if larger:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """vertex and component (the least vertex reachable) of each vertex with a link a, b other than itself."""
    edges = stored(links.select("a", "b").filter(F.col("a") != F.col("b")).distinct())
    before = None
    while True:
        last, edges = edges, stored(_star(_star(edges, True), False))
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    )
