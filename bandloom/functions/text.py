"""Text, identifier and URL expressions. All are built-in Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_ws(text: Column) -> Column:
    """Runs of Unicode white space become one space; null becomes empty."""
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def like_pattern(phrase: str) -> str:
    """%phrase% for ilike: % and _ stay wildcards, and a backslash before any other character is dropped.

    A backslash at the end escapes the closing wildcard, which must then be met literally.
    """
    out, rest = [], iter(f"%{phrase}%")
    for c in rest:
        if c == "\\":
            escaped = next(rest, "")
            out.append("\\" + escaped if escaped in ("%", "_", "\\") else escaped)
        else:
            out.append(c)
    return "".join(out)


def contains_phrase(column: Column, phrase: str) -> Column:
    return column.ilike(like_pattern(phrase))


def blot_type(target: Column, loading: Column) -> Column:
    phospho = strip(F.coalesce(target, F.lit(""))).rlike(r"(?i)\A(p-|phospho[- ])")  # no lower(), which costs far more than the match
    return F.when(loading, "loading_control").when(phospho, "phospho_signaling").otherwise("total_protein")


def dois(text: Column) -> Column:
    """Distinct DOIs in order of first appearance, without closing punctuation."""
    # Fixed value: the pattern of a DOI.
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+"), 0)
    return F.array_distinct(F.transform(found, lambda d: F.regexp_replace(d, r"[.,;)\]}<>]+$", "")))


def path_segment(value: Column) -> Column:
    """A safe file name part; `paper` when nothing is left."""
    safe = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(safe == "", "paper").otherwise(safe)


def run_slug(value: Column) -> Column:
    """A run folder's name of at most 80 characters; `source` when nothing is left."""
    safe = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")
    cut = F.substring(safe, 1, 80)
    return F.when(cut == "", "source").otherwise(cut)


def candidate_key(path: Column, page: Column) -> Column:
    """The path's file name without its last suffix, otherwise the page."""
    name = F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/]+)/*$", 1)
    stem = F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)
    return F.when(stem != "", stem).otherwise(F.concat(F.lit("page-"), F.coalesce(page.cast("string"), F.lit("unknown"))))


def source_scoped_key(source_id: Column, key: Column) -> Column:
    return F.when(source_id.isNull(), key).otherwise(F.concat(F.substring(F.sha2(source_id, 256), 1, 16), F.lit("-"), key))


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def public_url(url: Column) -> Column:
    """The URL if it is http or https and names a host, otherwise null."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(scheme.isin("http", "https") & (host != ""), url)


def record_doi(paper_id: Column, source_url: Column) -> Column:
    """From a doi.org URL's decoded path, otherwise from paper_id, otherwise null."""
    host = F.lower(F.regexp_extract(F.coalesce(source_url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    path = F.regexp_extract(F.coalesce(source_url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/*([^?#]*)", 1)
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    plain = F.regexp_replace(strip(F.coalesce(paper_id, F.lit(""))), r"(?i)^doi:\s*", "")
    whole = r"^10\.\d{4,9}/\S+$"
    return F.when(host.isin("doi.org", "dx.doi.org") & decoded.rlike(whole), decoded).when(plain.rlike(whole), plain)


def display(value: Column) -> Column:
    """What a table cell shows: a dash for null and empty, otherwise the value's text."""
    shown = value.cast("string")
    return F.when(F.coalesce(shown, F.lit("")) == "", "—").otherwise(shown)


def shown_percent(share: Column) -> Column:
    """A share as a whole per cent, halves rounded up; a dash for null."""
    return F.coalesce(F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%")), F.lit("—"))


def spaced(value: Column) -> Column:
    """A stored name as words: underscores as spaces."""
    return display(F.replace(value, F.lit("_"), F.lit(" ")))


def source_link(doi: Column, source_url: Column) -> Column:
    """Where a record's source can be seen: its web address, otherwise the DOI's, otherwise null."""
    encoded = F.array_join(F.transform(F.split(doi, "/"), lambda part: F.replace(F.url_encode(part), F.lit("+"), F.lit("%20"))), "/")
    for code, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):  # characters that a path part keeps
        encoded = F.replace(encoded, F.lit(code), F.lit(plain))
    return F.coalesce(public_url(source_url), F.when(doi != "", F.concat(F.lit("https://doi.org/"), encoded)))


def first_doi(*texts: Column) -> Column:
    """The first DOI of the first text that holds one."""
    return F.coalesce(*[F.try_element_at(dois(t), F.lit(1)) for t in texts])


def model_version(model: Column, revision: Column) -> Column:
    return F.concat(model, F.lit("@"), revision)


def sentences(text: Column) -> Column:
    """Cut after . ! ? before white space and an upper-case letter, digit or bracket."""
    # Where a sentence ends.
    parts = F.split(F.coalesce(text, F.lit("")), r"(?U)(?<=[.!?])\s+(?=[A-Z0-9(])")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def figure_reference(sentence: Column, label: Column) -> Column:
    """Whether a sentence refers to the label's first number, other than as a supplementary figure."""
    number = F.regexp_extract(label, r"\d+", 0)
    # How a sentence names a figure.
    pattern = F.concat(F.lit(r"(?iU)(?<!Supplementary )\bfig(?:ure)?s?\.?\s*"), number)
    return (number != "") & F.rlike(sentence, pattern)


def page_body(text: Column) -> Column:
    """A page's running text: cut at the first figure heading (and the panel letters over it), without furniture lines."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]")
    # What a figure heading and page furniture look like.
    heading = r"(?U)^\s*(?:FIGURE|Figure)\s+\d+\s*$"
    # position of the first heading, then back over single capitals: -1 means none
    at = F.array_position(F.transform(lines, lambda s: s.rlike(heading)), True).cast("int") - 1
    before = F.when(at >= 0, F.slice(lines, F.lit(1), at)).otherwise(lines)
    trimmed = F.aggregate(
        F.reverse(before),
        F.struct(F.array().cast("array<string>").alias("kept"), (at >= 0).alias("trimming")),
        lambda acc, s: F.struct(
            F.when(acc["trimming"] & s.rlike(r"(?U)^\s*[A-Z]\s*$"), acc["kept"]).otherwise(F.array_append(acc["kept"], s)).alias("kept"),
            (acc["trimming"] & s.rlike(r"(?U)^\s*[A-Z]\s*$")).alias("trimming"),
        ),
        lambda acc: F.reverse(acc["kept"]),
    )
    furniture = [r"(?U)^\s*\d{2}\s*$", r"(?U)^\s*10\.\d{4,9}/\S+\s*$", r"(?iU)^\s*\S+\s+et al\.\s*$", r"(?U)^\s*Frontiers in \S+(?:\s+\S+)*\s*$"]
    kept = F.filter(trimmed, lambda s: ~(reduce(Column.__or__, [s.rlike(p) for p in furniture]) | F.lower(s).contains("frontiersin.org")))
    return normalize_ws(F.regexp_replace(F.array_join(kept, "\n"), r"(?U)(?<=\w)-\n(?=\w)", "-"))
