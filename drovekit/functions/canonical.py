"""Canonical JSON: one text for one value, whatever the order of its keys and its spaces."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(text: str | None) -> str | None:
    """Sorted keys, ", " and ": " between parts, other characters than ASCII escaped; null for what isn't JSON."""
    try:
        return json.dumps(json.loads(text), sort_keys=True) if text is not None else None
    except (ValueError, RecursionError):
        return None


def _each(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for b in texts:
        known = {t: canonical(t) for t in b.dropna().unique()}  # a text that repeats is read once
        yield pd.Series([known.get(t) for t in b], dtype=object)


def canonical_json(text: Column) -> Column:
    """A column of JSON texts in their canonical form; null for null and for what isn't JSON."""
    return F.pandas_udf(_each, T.StringType())(text)


def short_hash(text: Column, digits: int = 12) -> Column:
    """The first digits of a text's SHA-256."""
    return F.substring(F.sha2(F.encode(text, "utf-8"), 256), 1, digits)
