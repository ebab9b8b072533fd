"""Comparison keys and digests for duplicate detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import _col, collapse_whitespace


def compare_text(c) -> Column:
    """Whitespace- and case-folded text; null compares as empty."""
    return F.lower(F.trim(collapse_whitespace(F.coalesce(_col(c), F.lit("")))))


def compare_keys(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Per column: folded text for strings, the value itself otherwise (-0.0 as 0.0)."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def key(name: str) -> Column:
        col = F.col(f"`{name}`")
        if isinstance(types[name], T.StringType):
            return compare_text(col)
        return col + 0.0 if isinstance(types[name], (T.DoubleType, T.FloatType)) else col

    return [key(c) for c in columns]


def value_keys(df: DataFrame, columns: Sequence[str]) -> list[Column] | None:
    """Per column a value whose text is equal exactly for equal values; None if a column has no such form."""
    types, out = {f.name: f.dataType for f in df.schema.fields}, []
    for name in columns:
        col, kind = F.col(f"`{name}`"), types[name]
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            out.append(col + F.lit(0.0).cast(kind))  # -0.0 as 0.0
        elif isinstance(kind, T.TimestampType):
            out.append(F.unix_micros(col))  # its text depends on the time zone
        elif isinstance(kind, T.BinaryType):
            out.append(F.hex(col))
        elif isinstance(kind, (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampNTZType)):
            out.append(col)
        else:
            return None
    return out


def row_digest(keys: Sequence[Column]) -> Column:
    """SHA-256 of a row's keys, as 32 bytes.

    Each key is written as its length and its text (nulls as ``-``), so that
    different rows never give the same input.  Grouping by the digest moves 32
    bytes per row instead of the whole text.
    """
    parts = [
        F.coalesce(F.concat(F.octet_length(k.cast("string")).cast("string"), F.lit(":"), k.cast("string")), F.lit("-"))
        for k in keys
    ]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))
