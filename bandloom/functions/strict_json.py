"""JSON as Python's json module reads it, at the border to VARIANT.

Spark's parser accepts text after a document and refuses repeated keys; model output and cache
lines need the opposite. One Arrow function reads strictly and hands on canonical JSON.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip


def _finite(value):
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {k: _finite(v) for k, v in value.items()}
    return [_finite(v) for v in value] if isinstance(value, list) else value


def _load(text: str) -> str | None:
    try:
        return json.dumps(_finite(json.loads(text)), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """Canonical JSON of each text that is one whole document, otherwise null."""
    return texts.map(lambda t: None if t is None else _load(t))


def model_json(raw: Column, shown: int = 1200) -> Column:
    """VARIANT of a model's answer: fences and thoughts go, then the whole, then the outermost braces are tried.

    Otherwise {"error": "bad_json", "raw": the start of what is left}. A closing thought mark without
    an opening one before it ends the removal.
    """
    text = F.replace(F.replace(strip(F.coalesce(raw, F.lit(""))), F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    text = strip(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    found = F.coalesce(canonical_json(text), canonical_json(inner))
    failed = F.to_json(F.struct(F.lit("bad_json").alias("error"), F.substring(text, 1, shown).alias("raw")))
    return F.parse_json(F.coalesce(found, failed))
