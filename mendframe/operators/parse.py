"""Lenient parsing: every row gets the width of the header."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import conform, fields


def with_conformed(df: DataFrame, record, delimiter, width) -> DataFrame:
    """Add ``n_fields``, ``cells`` (cut or padded), ``too_long``, ``too_short``, ``repaired``."""
    n = width if isinstance(width, Column) else F.lit(width)
    return (
        df.withColumn("_fields", fields(record, delimiter))
        .withColumn("n_fields", F.size("_fields"))
        .withColumns({
            "cells": conform("_fields", n),
            "too_long": F.col("n_fields") > n,
            "too_short": F.col("n_fields") < n,
            "repaired": F.col("n_fields") != n,
        })
        .drop("_fields")
    )


def as_table(df: DataFrame, header: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Spread ``cells`` over named string columns."""
    cells = [F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(header)]
    return df.select(*keep, *cells)


def repair_counters(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(rows, too_long, too_short, repaired_rows, import_warning), optionally per key."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("too_long").alias("too_long"),
        F.count_if("too_short").alias("too_short"),
        F.count_if("repaired").alias("repaired_rows"),
        (F.count_if("repaired") > 0).alias("import_warning"),
    )
