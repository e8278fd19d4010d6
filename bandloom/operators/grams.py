"""An inverted index of trigrams by file: which files can hold a phrase, so that a substring search need not open the rest."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SCHEMA = "gram STRING, field STRING, file STRING"


def required(phrase: str) -> set[str]:
    """The trigrams that a value matched by contains_phrase holds, lower-cased.

    Those of the runs between wildcards, and of ASCII characters alone, whose lower case is the same beside any others;
    a phrase whose runs are shorter than three has none, and rules nothing out.
    """
    runs, rest = [""], iter(T.like_pattern(phrase))
    for c in rest:
        wild = c in "%_"
        c = next(rest) if c == "\\" else c
        if wild or not c.isascii():
            runs.append("")
        else:
            runs[-1] += c.lower()
    return {run[i : i + 3] for run in runs for i in range(len(run) - 2)}


def _grams(field: str) -> Column:
    """gram and field of the distinct ASCII trigrams of a column's lower-cased text; none for null and under three characters."""
    low = F.lower(F.col(field))
    starts = F.when(F.length(low) > 2, F.sequence(F.lit(1), F.length(low) - 2)).otherwise(F.array().cast("array<int>"))
    plain = F.filter(F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(3)))), lambda g: g.rlike(r"^[\x00-\x7f]{3}\z"))
    return F.transform(plain, lambda g: F.struct(g.alias("gram"), F.lit(field).alias("field")))


def index(rows: DataFrame, file: Column, fields: Sequence[str]) -> DataFrame:
    """gram, field and file of all rows, each once, sorted so that a lookup reads few row groups.

    Tasks combine their own trigrams first: what is shuffled is the vocabulary of each file, not its rows.
    """
    found = rows.select(file.alias("file"), F.explode(F.concat(*[_grams(c) for c in fields])).alias("found"))
    return found.select("found.gram", "found.field", "file").distinct().sortWithinPartitions("gram", "field")


def files_holding(index: DataFrame, asked: Iterable[tuple[set[str], Sequence[str]]]) -> DataFrame:
    """file of those where, for every (trigrams, fields), one of the fields holds all the trigrams."""
    asked = list(asked)
    wanted = sorted(set().union(*(grams for grams, _ in asked)))
    held = index.filter(F.col("gram").isin(*wanted)).groupBy("file", "field").agg(F.collect_set("gram").alias("grams"))  # at most the trigrams asked for
    met = [F.bool_or(F.col("field").isin(*fields) & (F.size(F.array_except(F.lit(sorted(grams)), F.col("grams"))) == 0)) for grams, fields in asked]
    return held.groupBy("file").agg(*[m.alias(f"_{i}") for i, m in enumerate(met)]).filter(reduce(Column.__and__, [F.col(f"_{i}") for i in range(len(met))])).select("file")
