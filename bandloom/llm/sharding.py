"""Shards by rendezvous hashing of stable record keys."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LAW = "key"


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the greatest weighted score for this key, the lower number on a tie.

    A score is -weight / ln(u) with u from the MD5 of key and shard, so each record ranks all
    shards once and for all: a new shard takes records only into itself. Equal weights compare u alone.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    level = len(set(weights)) == 1
    scores = []
    for shard, weight in enumerate(weights):
        u = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), F.lit(str(shard))).cast("binary")), 1, 13), 16, 10).cast("long")
        score = u if level else F.lit(-float(weight)) / F.log((u.cast("double") + 0.5) / float(1 << 52))
        scores.append(F.struct(score.alias("score"), F.lit(-shard).alias("minus")))
    return (-(F.greatest(*scores) if len(scores) > 1 else scores[0])["minus"]).cast("int")


def shard_records(docs: DataFrame, shards: int = 24, weights: Sequence[float] | None = None, part_rows: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every record.

    The law is key: doc_id and the shard count decide. Null text: size 8 and the CRC of nothing. A
    null doc_id is a key of its own; repeated rows share a shard and take a slot each; other
    columns are ignored; no rows give no rows. Slots count from 0 in each shard, by hashed parts of
    about part_rows rows and in them by doc_id, so no task orders a whole shard.
    """
    weights = list(weights or [1.0] * shards)
    body = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    rows = rows.withColumns({"shard": rendezvous(F.col("doc_id"), weights), "grown_shard": rendezvous(F.col("doc_id"), [*weights, sum(weights) / len(weights)])})
    parts = max(1, math.ceil(docs.select("doc_id").count() / len(weights) / part_rows))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    placed = rows.withColumn("place", place).join(offsets, ["shard", "part"])
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("place") + F.col("before")).cast("long").alias("slot"), "grown_shard")


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(spark.read.parquet(f"{sf_dir}/documents.parquet"))
