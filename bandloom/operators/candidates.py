"""Candidate crops: geometry, scoring gates and formula, splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


LEAST_AREA, WHOLE_PAGE = 40_000, 0.95  # fixed values: pixels of a box, share of a page's sides


def expand_bbox(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column, left: int = 240, top: int = 60, right: int = 20, bottom: int = 20) -> Column:
    """x1, y1, x2, y2 with margins, held to the page."""
    return F.array(F.greatest(F.lit(0), x - left), F.greatest(F.lit(0), y - top), F.least(page_w, x + w + right), F.least(page_h, y + h + bottom))


def passes_geometry(w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """Large enough, and not nearly the whole page."""
    return (w * h >= LEAST_AREA) & ~((w > page_w * WHOLE_PAGE) & (h > page_h * WHOLE_PAGE))


def passes_gates(w: Column, h: Column, dark: Column) -> Column:
    aspect = w / F.greatest(h, F.lit(1))
    return (w >= 180) & (h >= 80) & (w * h >= LEAST_AREA) & aspect.between(0.6, 8.0) & dark.between(0.01, 0.65)


def candidate_score(w: Column, h: Column, saturation: Column, dark: Column, horizontal: Column, row_ratio: Column, col_ratio: Column) -> Column:
    """0 outside the gates, otherwise a weighted sum; colourful crops keep two fifths of it."""
    one = F.lit(1.0)
    raw = (
        0.25 * F.greatest(F.lit(0.0), 1 - saturation / 80) + 0.20 * F.least(dark / 0.18, one) + 0.30 * F.least(horizontal / 0.08, one)
        + 0.15 * F.least(row_ratio / 1.8, one) + 0.10 * F.least(col_ratio / 2.5, one)
    )
    return F.when(passes_gates(w, h, dark), F.when(saturation > 70, raw * 0.4).otherwise(raw)).otherwise(0.0)


def good_candidates(rows: DataFrame, score: str = "cv_score", least: float = 0.65) -> DataFrame:
    return rows.filter(F.coalesce(F.col(score), F.lit(0.0)) >= least)


def top_candidates(rows: DataFrame, score: str, sequence: str, n: int = 20) -> DataFrame:
    """The n best by score, equal scores in sequence, with the score to three places."""
    return rows.orderBy(F.desc(score), F.asc(sequence)).limit(n).withColumn(score, F.bround(score, 3))


def split_boxes(w: Column, h: Column) -> Column:
    """Two boxes (part, x1, y1, x2, y2) for a large crop, none otherwise; they share an edge only."""
    overlap = F.least(F.lit(120), F.greatest(F.lit(40), F.floor(h / 14)))
    cut = F.least(h - 200, F.greatest(F.lit(200), F.floor(h / 2) + overlap)).cast("int")
    box = lambda part, y1, y2: F.struct(F.lit(part).alias("part"), F.lit(0).alias("x1"), y1.alias("y1"), w.alias("x2"), y2.alias("y2"))
    return F.when((h >= 1200) & (w >= 900), F.array(box(1, F.lit(0), cut), box(2, cut, h))).otherwise(F.array().cast("array<struct<part:int,x1:int,y1:int,x2:int,y2:int>>"))


def scaled_size(w: Column, h: Column, longest: int = 1800) -> Column:
    """width and height after shrinking so that neither side passes longest."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(w, h))
    return F.struct((w * scale).cast("int").alias("width"), (h * scale).cast("int").alias("height"))
