"""Numeric columns hidden in text: eligibility and conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.names import ignorable_columns
from ..functions.numbers import with_parsed
from ..functions.text import is_blank
from .clean import long_form, quoted, text_columns


def numeric_eligibility(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """(column, n, ok, rate, eligible) per text column, from one aggregate."""
    texts = text_columns(df, order_by)
    parsed = with_parsed(df, {f"_value_{i}": c for i, c in enumerate(texts)})
    counted = long_form(parsed, {
        c: {"n": F.count_if(~is_blank(quoted(c))), "ok": F.count(F.col(f"_value_{i}"))} for i, c in enumerate(texts)
    })
    rate = F.when(F.col("n") > 0, F.col("ok") / F.col("n")).otherwise(F.lit(0.0))
    return counted.withColumn("rate", rate).withColumn(
        "eligible", (F.col("n") >= K.NUMERIC_MIN_VALUES) & (F.col("rate") >= K.NUMERIC_MIN_SHARE)
    )


def normalize_numbers(df: DataFrame, order_by: str | None = None, exclude_ignored: bool = False,
                      on_unparseable: str = "null") -> DataFrame:
    """Convert eligible text columns to double; blanks and odd cells become null.

    ``exclude_ignored`` leaves id, date and balance columns alone;
    ``on_unparseable='skip_column'`` converts only columns that lose nothing.
    Reads at most one row per column back to plan the projection.
    """
    facts = numeric_eligibility(df, order_by).filter("eligible")
    if on_unparseable == "skip_column":
        facts = facts.filter("ok = n")
    chosen = {r["column"] for r in facts.collect()}
    if exclude_ignored:
        chosen -= set(ignorable_columns(df.columns))
    values = {f"_value_{i}": c for i, c in enumerate(df.columns) if c in chosen}
    parsed, new = with_parsed(df, values), {c: v for v, c in values.items()}
    return parsed.select([F.col(new[c]).alias(c) if c in new else quoted(c) for c in df.columns])
