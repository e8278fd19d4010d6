"""Catalog search: criteria to a predicate, an exact count and an ordered page."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from ..functions import text as T

# Words that say nothing about a sample or a condition.
SAMPLE_STOPWORDS = frozenset({"cell", "cells", "line", "sample", "samples", "tissue"})
CONDITION_STOPWORDS = frozenset({"after", "before", "condition", "conditions", "during", "exposed", "exposure", "treated", "treatment", "under", "with"})
MAX_LENGTHS = {"q": 1000, "target": 200, "sample": 200, "condition": 200, "paper_id": 500}


@dataclass(frozen=True)
class Criteria:
    """Query parameters; None or blank means not asked."""

    q: str | None = None
    target: str | None = None
    sample: str | None = None
    condition: str | None = None
    paper_id: str | None = None


@dataclass(frozen=True)
class Columns:
    """Which columns of a table play which part."""

    paper: str = "paper_id"
    target: str = "target"
    sample: Sequence[str] = ("sample", "organism")
    condition: Sequence[str] = ("condition", "treatment_context")
    everywhere: Sequence[str] = ("target", "sample", "organism", "condition", "treatment_context", "paper_id")


def search_terms(value: str, stopwords: frozenset[str]) -> list[str]:
    """Words of the value without stopwords; the whole value when none is left."""
    # What makes a term.
    terms = [t for t in re.findall(r"[A-Za-z0-9][A-Za-z0-9_.+-]*", value) if t.casefold() not in stopwords]
    return terms or [value.strip()]


def phrases(criteria: Criteria, columns: Columns = Columns()) -> list[tuple[str, Sequence[str]]]:
    """The phrases that a row must hold, each with the columns of which any may hold it."""
    asked = {k: v.strip() for k, v in vars(criteria).items() if v and v.strip()}
    out: list[tuple[str, Sequence[str]]] = [(asked["target"], (columns.target,))] if "target" in asked else []
    if "sample" in asked:
        out += [(t, columns.sample) for t in search_terms(asked["sample"], SAMPLE_STOPWORDS)]
    if "condition" in asked:
        out += [(t, columns.condition) for t in search_terms(asked["condition"], CONDITION_STOPWORDS)]
    if "q" in asked:
        out += [(t, columns.everywhere) for t in asked["q"].split()]
    return out


def predicate(criteria: Criteria, columns: Columns = Columns()) -> Column:
    """All asked criteria and-ed; each term of a multi-field criterion may be met by any of its fields."""
    paper = (criteria.paper_id or "").strip()
    clauses = [F.col(columns.paper) == paper] if paper else []
    clauses += [reduce(Column.__or__, [T.contains_phrase(F.col(c), term) for c in fields]) for term, fields in phrases(criteria, columns)]
    return reduce(Column.__and__, clauses, F.lit(True))


def page_bounds(limit: int = 100, offset: int = 0) -> tuple[int, int]:
    return max(1, min(limit, 200)), max(0, offset)


@dataclass(frozen=True)
class Key:
    """A column to order by, whole numbers, dates or times."""

    name: str
    descending: bool = True
    nulls_first: bool = True

    def order(self, turned: bool = False) -> Column:
        down, first = self.descending != turned, self.nulls_first != turned
        return {(True, True): F.desc_nulls_first, (True, False): F.desc_nulls_last, (False, True): F.asc_nulls_first, (False, False): F.asc_nulls_last}[down, first](self.name)

    def place(self, rows: DataFrame) -> Column | None:
        """A whole number that ascends in this order, null for null; None where the column has none."""
        kind, column = rows.schema[self.name].dataType, F.col(self.name)
        if isinstance(kind, types.TimestampType):
            value = F.unix_micros(column)
        elif isinstance(kind, types.DateType):
            value = F.unix_date(column).cast("long")
        elif isinstance(kind, (types.ByteType, types.ShortType, types.IntegerType, types.LongType)):
            value = column.cast("long")
        else:
            return None
        return F.bitwise_not(value) if self.descending else value


def _selected(hits: DataFrame, keys: Sequence[Key], limit: int, offset: int, most: int, slices: int = 1024) -> DataFrame:
    """The page at an offset by histograms of the keys, without sorting what lies before it.

    Each pass counts the hits that are left in at most slices equal parts of a key's range and goes on with the part that
    holds the page; at most seven passes narrow a key to one value, and its ties go on by the next key. A part of at
    most `most` hits is a top-k. Where the page begins in one part and ends in later ones, it is the last hits of the one
    and the first of what follows.
    """
    order, turned = [k.order() for k in keys], [k.order(turned=True) for k in keys]
    region, skip = F.lit(True), 0

    def narrowed(parts: list[tuple[int, Column, Column]]) -> DataFrame | tuple[int, int, Column] | None:
        """parts: in order, each with its count, what lies in it and what lies after it. The page, or the part to go on with."""
        before = skip
        for n, inside, after in parts:
            if offset < before + n:
                if offset + limit <= before + n or inside is parts[-1][1]:
                    return before, n, region & inside
                own = before + n - offset
                tail = hits.filter(region & inside).orderBy(*turned).limit(own)
                head = hits.filter(region & after).orderBy(*order).limit(limit - own)
                return tail.unionByName(head).orderBy(*order)
            before += n
        return None  # past the end

    for key in keys:
        place = key.place(hits)
        isnull, there = place.isNull(), place.isNotNull()
        counted = hits.filter(region).agg(F.count_if(isnull).alias("nulls"), F.count(place).alias("n"), F.min(place).alias("low"), F.max(place).alias("high")).first()
        bands = [(counted.nulls, isnull, there), (counted.n, there, F.lit(False))] if key.nulls_first else [(counted.n, there, isnull), (counted.nulls, isnull, F.lit(False))]
        found = narrowed([b for b in bands if b[0]])
        low, high = counted.low, counted.high
        while isinstance(found, tuple):
            skip, n, region = found
            if n <= most:
                return hits.filter(region).orderBy(*order).offset(offset - skip).limit(limit)
            if low is None or low == high or offset < skip or (counted.nulls and (offset < counted.nulls) == key.nulls_first and n == counted.nulls):
                break  # ties: on with the next key
            width = -(-(high - low + 1) // slices)
            rows = hits.filter(region).select(place.alias("_p"))
            wide = lambda value: f"CAST({value} AS DECIMAL(38,0))"
            part = F.expr(f"int(({wide('_p')} - {wide(f"'{low}'")}) div {wide(f"'{width}'")})")
            counts = sorted((r.part, r["count"]) for r in rows.groupBy(part.alias("part")).count().collect())  # at most slices rows
            found = narrowed([(n, place.between(low + p * width, min(high, low + (p + 1) * width - 1)), place > min(high, low + (p + 1) * width - 1)) for p, n in counts])
            if isinstance(found, tuple):
                before = skip
                for p, n in counts:
                    if before == found[0]:
                        low, high = low + p * width, min(high, low + (p + 1) * width - 1)
                        break
                    before += n
        if found is None:
            return hits.limit(0)
        if not isinstance(found, tuple):
            return found
    return hits.filter(region).limit(offset - skip + limit).offset(offset - skip)  # equal in every key: any of them


def search_page(rows: DataFrame, where: Column, order: Sequence[Column | Key], limit: int = 100, offset: int = 0, deep: int = 10_000) -> DataFrame:
    """One ordered page; an offset past the end gives no rows. Up to deep rows it is a top-k.

    Past that no task could hold the rows before it. Ordered by Keys, a deep page is found by histograms; by other
    columns the hits are sorted by ranges once, counted by partition (one row each to the driver) and read at the places needed.
    """
    limit, offset = page_bounds(limit, offset)
    hits = rows.filter(where)
    keys = [k for k in order if isinstance(k, Key)]
    if offset + limit > deep and len(keys) == len(order) and all(k.place(rows) is not None for k in keys):
        return _selected(hits, keys, limit, offset, deep)
    order = [k.order() if isinstance(k, Key) else k for k in order]
    if offset + limit <= deep:
        return hits.orderBy(*order).offset(offset).limit(limit)
    at = "at" + "_" * max(len(c) for c in rows.columns)
    placed = hits.orderBy(*order).withColumn(at, F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY)
    part = F.shiftright(at, 33)
    before, wanted = 0, F.lit(False)
    for number, n in placed.groupBy(part.alias("part")).agg(F.count("*")).sort("part").collect():
        first, last = max(offset - before, 0), min(offset + limit - before, n) - 1
        if first <= last:
            wanted = wanted | F.col(at).between((number << 33) + first, (number << 33) + last)
        before += n
    return placed.filter(wanted).orderBy(at).drop(at)


def search_total(rows: DataFrame, where: Column) -> DataFrame:
    return rows.filter(where).agg(F.count("*").alias("total"))


def validate(criteria: Criteria, limit: int, offset: int) -> None:
    """The façade's bounds; the page builder clamps on its own."""
    for name, longest in MAX_LENGTHS.items():
        if len(getattr(criteria, name) or "") > longest:
            raise ValueError(f"{name} is longer than {longest}")
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1..200 and offset not negative")


def get_by_id(rows: DataFrame, record_id: int, column: str = "id") -> DataFrame:
    return rows.filter(F.col(column) == record_id).limit(1)


def page_number(offset: Column, limit: int) -> Column:
    return F.floor(offset / limit).cast("long") + 1


def page_count(total: Column, limit: int) -> Column:
    return F.ceil(total / limit).cast("long")


def last_offset(total: Column, limit: int) -> Column:
    """Where a request past the end lands."""
    return (F.floor((F.greatest(total, F.lit(1)) - 1) / limit) * limit).cast("long")
