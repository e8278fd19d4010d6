"""How text filters interact: a histogram of failure masks, and from its cells every order of the filters.

A document's mask holds one bit for each filter that it fails. What a filter removes, repeats or alone
catches in any order follows from how many documents have which mask, so all orders come from at most
2^filters cells a part and no text is read twice.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Which of the filters A to D a text fails: few words, repeated words, capitals, marks."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column], part: Column) -> DataFrame:
    """part, mask, good, toxic of each document: bit k for the k-th filter, the last bit for a repeated text.

    A text is repeated if a smaller doc_id has an equal one (equal SHA-256) anywhere in the table. Rows of one
    doc_id do not repeat each other; a row without doc_id neither repeats nor is repeated, and has no labels. Of
    several labels of one doc_id the greatest counts. Texts are read once; digests and ids are shuffled, never texts,
    and the least doc_id of a text is found by partial aggregation, so a text of any number of copies is no hot group.
    """
    text = F.coalesce("text", F.lit(""))
    bits = sum((F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate(filters.values())), F.lit(0))
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), bits.cast("int").alias("mask")))
    named = rows.where(F.col("doc_id").isNotNull())
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*(F.max((F.col(c) == 1).cast("long")).alias(c) for c in ("quality", "toxic")))
    repeated = F.when(F.col("first"), 0).otherwise(1 << len(filters))
    marked = named.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    counted = [F.coalesce(c, F.lit(0)).cast("long").alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    nameless = rows.where(F.col("doc_id").isNull()).select("part", "mask", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return marked.select("part", F.col("mask").bitwiseOR(repeated).alias("mask"), *counted).unionByName(nameless)


def interactions(masks: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the letters and step, from the cells of each part's histogram.

    kept, removed, redundant, unique_fails, good_lost, toxic_lost at that step; shapley: the documents that its
    filter removes, summed over all orders. Zeros are rows too; a part without documents does not exist, so no
    rows give no rows.
    """
    orders = ["".join(p) for p in permutations(letters)]
    steps = len(letters)
    bit = {c: 1 << k for k, c in enumerate(letters)}
    before = [sum(bit[c] for c in order[:k]) for order in orders for k in range(steps)]
    own = [bit[order[k]] for order in orders for k in range(steps)]
    cells = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    at = F.explode(F.sequence(F.lit(0), F.lit(len(before) - 1)))
    nth = lambda values: F.element_at(F.lit(values), F.col("at") + 1)
    placed = cells.withColumn("at", at).withColumns({"own": nth(own), "before": nth(before)})
    mask, failing = F.col("mask"), F.bit_count("mask")
    fails, gone = mask.bitwiseAND(F.col("own")) != 0, mask.bitwiseAND(F.col("before")) != 0
    total = lambda rows, n="n": F.coalesce(F.sum(F.when(rows, F.col(n))), F.lit(0)).cast("long")
    sums = {
        "kept": total(~fails & ~gone),
        "removed": total(fails & ~gone),
        "redundant": total(fails & gone),
        "unique_fails": total(mask == F.col("own")),
        "good_lost": total(fails & ~gone, "good"),
        "toxic_lost": total(fails & ~gone, "toxic"),
        "shapley": F.coalesce(F.sum(F.when(fails, F.expr(f"n * {len(orders)} div bit_count(mask)"))), F.lit(0)).cast("long"),
    }
    out = placed.groupBy("part", "at").agg(*(c.alias(name) for name, c in sums.items()))
    return out.select("part", F.element_at(F.lit(orders), F.expr(f"int(at div {steps}) + 1")).alias("filter_order"), (F.col("at") % steps + 1).cast("int").alias("step"), *sums)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over whole texts, by lang (null: empty string): all 120 orders and their steps.

    A null text is an empty one; texts of any length are worked through in linear time; repeated rows count each;
    other columns, whatever their names, are ignored; no rows give no rows.
    """
    filters = text_filters(F.coalesce("text", F.lit("")))
    return interactions(failure_masks(docs, labels, filters, F.coalesce("lang", F.lit(""))), "ABCDE")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
WITH split AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
    len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words), 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body),
    regexp_matches(body, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false)] AS fails
  FROM split LEFT JOIN marks USING (doc_id)
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
  SELECT a.c || b.c || d.c || e.c || f.c AS filter_order FROM letters a, letters b, letters d, letters e, letters f
  WHERE len(list_distinct([a.c, b.c, d.c, e.c, f.c])) = 5
), steps AS (SELECT filter_order, s::INT AS step FROM orders, range(1, 6) r(s)),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL),
seen AS (
  SELECT part, filter_order, step, n, good, toxic, fails[position(filter_order[step] IN 'ABCDE')] AS own, len(list_filter(fails, lambda x: x)) AS failing,
    len(list_filter(range(1, step), lambda i: fails[position(filter_order[i] IN 'ABCDE')])) > 0 AS gone
  FROM cells, steps
)
SELECT part, filter_order, step, (coalesce(sum(n) FILTER (NOT own AND NOT gone), 0))::BIGINT AS kept, (coalesce(sum(n) FILTER (own AND NOT gone), 0))::BIGINT AS removed,
  (coalesce(sum(n) FILTER (own AND gone), 0))::BIGINT AS redundant, (coalesce(sum(n) FILTER (own AND failing = 1), 0))::BIGINT AS unique_fails,
  (coalesce(sum(good) FILTER (own AND NOT gone), 0))::BIGINT AS good_lost, (coalesce(sum(toxic) FILTER (own AND NOT gone), 0))::BIGINT AS toxic_lost,
  (sum(sum(coalesce(n, 0)) FILTER (own AND NOT gone)) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley
FROM seen GROUP BY part, filter_order, step
"""
