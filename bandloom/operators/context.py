"""Text around evidence: neighbouring pages, snippets, figure windows, sentence groups."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Sample and method words, in the order in which they use up the snippet allowance.
SAMPLE_KEYWORDS = (
    "cell", "cells", "cell line", "cell lines", "tissue", "tissues", "tumor", "tumour", "lysate", "lysates", "sample", "samples",
    "mouse", "mice", "rat", "human", "patient", "primary", "culture", "cultured", "organoid", "xenograft", "biopsy", "fibroblast",
    "macrophage", "neuron", "epithelial", "breast", "colon", "lung", "liver", "brain", "kidney", "western blot", "immunoblot", "immunoblotting",
)
# Figure mentions, in the order in which their windows are listed.
FIGURE_PATTERNS = (
    r"\bFigure\s+\d+", r"\bFig\.\s*\d+", r"\bFigure\s+S\d+", r"\bFig\.\s*S\d+",
    r"\bSupplementary\s+Figure\s+\d+", r"\bSupplementary\s+Fig\.\s*\d+", r"\bExtended\s+Data\s+Fig\.\s*\d+",
)


def ordered_text(rows: DataFrame, keys: Sequence[str], position: str, piece: Column, separator: str) -> DataFrame:
    """Each group's pieces joined in order of position."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(position).alias("at"), piece.alias("piece"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["piece"]), separator).alias("full_text"))


def page_marked(page: Column, text: Column) -> Column:
    return F.concat(F.lit("--- PAGE "), page.cast("string"), F.lit(" ---\n"), F.coalesce(text, F.lit("")))


def neighbour_text(rows: DataFrame, pages: DataFrame, key: str, page: str, text: str, radius: int = 1, longest: int = 2500) -> DataFrame:
    """key, page and the marked texts of the pages around it: an equi-join after listing the wanted pages."""
    wanted = rows.select(key, F.col(page).alias("at"), F.explode(F.sequence(F.col(page) - radius, F.col(page) + radius)).alias("near"))
    given = pages.select(F.col(key).alias("_key"), F.col(page).alias("_page"), F.substring(T.normalize_ws(F.col(text)), 1, longest).alias("_text"))
    joined = wanted.join(given, (F.col(key) == F.col("_key")) & (F.col("near") == F.col("_page")), "left").filter(F.col("_page").isNotNull())
    return ordered_text(joined, [key, "at"], "near", page_marked(F.col("near"), F.col("_text")), "\n\n").withColumnRenamed("at", page)


def match_offsets(text: Column, pattern: str, most: int | None = None) -> Column:
    """0-based starts, in characters, of the (first `most`) non-overlapping matches; null text has none."""

    @F.pandas_udf("array<int>")
    def starts(texts: pd.Series) -> pd.Series:
        found = re.compile(pattern)
        return texts.map(lambda t: [m.start() for m in islice(found.finditer(t or ""), most)])

    return starts(text)


def _first_of_each(pieces: Iterable[str], length: int) -> list[str]:
    """The first piece of each lower-cased prefix, in order."""
    by_prefix: dict[str, str] = {}
    for piece in pieces:
        by_prefix.setdefault(piece[:length].lower(), piece)
    return list(by_prefix.values())


def dedupe_prefix(chunks: Column, length: int = 250) -> Column:
    """The first chunk of each lower-cased prefix, in order; null chunks are left out."""

    @F.pandas_udf("array<string>")
    def firsts(lists: pd.Series) -> pd.Series:
        return lists.map(lambda given: None if given is None else _first_of_each([c for c in given if c is not None], length))

    return firsts(chunks)


def _first_until(clean: str, mentions: Iterable[re.Pattern], longest: int) -> list[str]:
    """The windows of figure mentions, the first of each prefix, until together they are as long as asked."""
    by_prefix: dict[str, str] = {}
    size = 0
    for mention in mentions:
        for hit in mention.finditer(clean):
            window = clean[max(0, hit.start() - 300) : hit.start() + 2500]
            prefix = window[:250].lower()
            if prefix not in by_prefix:
                by_prefix[prefix] = window
                size += len(window)
                if size >= longest:
                    return list(by_prefix.values())
    return list(by_prefix.values())


def _of_each(texts: pa.Array, of_one: Callable[[str], str]) -> pa.Array:
    """of_one of every text; only a few dozen of a batch are Python objects at a time."""
    step = 64
    found = [pa.array([of_one(t.as_py()) for t in texts.slice(i, step)], pa.string()) for i in range(0, len(texts), step)]
    return pa.concat_arrays(found) if found else pa.array([], pa.string())


def snippets(text: Column, terms: Sequence[str] = SAMPLE_KEYWORDS, most: int = 16, reach: int = 350) -> Column:
    """Bulleted windows around the terms' hits: three times `most` hits in all, then one more for each later term that hits."""

    @F.arrow_udf("string")
    def joined(texts: pa.Array) -> pa.Array:
        wanted = [re.compile(re.escape(term.lower())) for term in terms]

        def of_one(clean: str) -> str:
            low, windows = clean.lower(), []
            for term in wanted:
                allowed = max(1, most * 3 - len(windows))
                windows += [clean[max(0, hit.start() - reach) : hit.end() + reach] for hit in islice(term.finditer(low), allowed)]
            return "\n\n".join(f"- {window}" for window in _first_of_each(windows, 250)[:most])

        return _of_each(texts, of_one)

    return joined(T.normalize_ws(text))


def figure_context(text: Column, longest: int = 5000) -> Column:
    """Windows from 300 before to 2,500 after each figure mention, by pattern, joined and cut; those beyond the cut are not sought."""

    @F.arrow_udf("string")
    def joined(texts: pa.Array) -> pa.Array:
        mentions = [re.compile(pattern, re.IGNORECASE) for pattern in FIGURE_PATTERNS]

        def of_one(clean: str) -> str:
            return "\n\n".join(_first_until(clean, mentions, longest))[:longest]

        return _of_each(texts, of_one)

    return joined(T.normalize_ws(text))


def candidate_context(paper_id: Column, page: Column, bbox: Column, nearby: Column, figures: Column, methods: Column, longest: int = 12000) -> Column:
    """The text block that goes with a candidate; figures and methods are figure_context and snippets of the paper's text."""
    box = F.concat(F.lit("["), F.array_join(bbox.cast("array<string>"), ", "), F.lit("]"))
    block = F.concat(
        F.lit("\nPAPER_ID: "), paper_id, F.lit("\nCROP_PAGE: "), page.cast("string"), F.lit("\nCROP_BBOX_PAGE: "), box,
        F.lit("\n\nNEARBY_PAGE_TEXT:\n"), nearby, F.lit("\n\nLIKELY_FIGURE_OR_CAPTION_CONTEXT:\n"), figures,
        F.lit("\n\nPAPER_SAMPLE_OR_METHODS_SNIPPETS:\n"), methods, F.lit("\n"),
    )
    return F.substring(block, 1, longest)


def with_user_context(context: Column, text: Column, longest: int = 12000) -> Column:
    return F.substring(F.concat_ws("\n\n", context, text), 1, longest)


def sentence_rows(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """key, pos (from 0) and sentence."""
    return rows.select(key, F.posexplode(T.sentences(text)).alias("pos", "sentence"))


def context_groups(sentences: DataFrame, key: str, matches: Column) -> DataFrame:
    """Runs of sentences near a match: key, paragraph_no (from 1), paragraph.

    A match keeps the two sentences before it, itself and the one after.
    """
    order = Window.partitionBy(key).orderBy("pos")
    near = F.max(matches.cast("int")).over(order.rowsBetween(-1, 2)) == 1
    kept = sentences.withColumn("near", near).filter("near").withColumn("island", F.col("pos") - F.row_number().over(order))
    joined = ordered_text(kept, [key, "island"], "pos", F.col("sentence"), " ")
    return joined.select(key, F.row_number().over(Window.partitionBy(key).orderBy("island")).alias("paragraph_no"), F.col("full_text").alias("paragraph"))


def page_context(records: DataFrame, pages: DataFrame) -> DataFrame:
    """id and paper_context of records: sentences about the record's figure on pages page-2 .. page+1.

    records: id, run, page, figure_label; pages: run, page, text and page_no, the file order.
    """
    wanted = records.filter(F.regexp_extract("figure_label", r"\d+", 0) != "").select("id", "run", "figure_label", F.explode(F.sequence(F.col("page") - 2, F.col("page") + 1)).alias("page"))
    bodies = pages.select("run", "page", "page_no", T.page_body(F.col("text")).alias("body")).filter("body <> ''")
    texts = ordered_text(wanted.hint("merge").join(bodies, ["run", "page"]), ["id", "figure_label"], "page_no", F.col("body"), " ")
    rows = texts.select("id", "figure_label", F.posexplode(T.sentences(F.col("full_text"))).alias("pos", "sentence"))
    groups = context_groups(rows.withColumn("hit", T.figure_reference(F.col("sentence"), F.col("figure_label"))), "id", F.col("hit"))
    return ordered_text(groups, ["id"], "paragraph_no", F.col("paragraph"), "\n\n").withColumnRenamed("full_text", "paper_context")
