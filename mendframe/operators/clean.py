"""Table cleaning: names, whitespace, empty rows, the standard clean pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import snake_case_name, unique_name_list
from ..functions.text import is_blank, strip


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def data_columns(df: DataFrame, order_by: str | None) -> list[str]:
    return [c for c in df.columns if c != order_by]


def text_columns(df: DataFrame, order_by: str | None = None) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != order_by]


def long_form(df: DataFrame, rows: dict[str, dict[str, Column]]) -> DataFrame:
    """One aggregate over all columns, returned as one row per column.

    ``rows`` maps a column name to its named aggregates.  A single pass over
    the data computes everything, whatever the number of columns.
    """
    flat = {f"_{i}_{metric}": agg for i, metrics in enumerate(rows.values()) for metric, agg in metrics.items()}
    one = df.agg(*[agg.alias(name) for name, agg in flat.items()])
    structs = [
        F.struct(F.lit(col).alias("column"), *[F.col(f"_{i}_{m}").alias(m) for m in metrics])
        for i, (col, metrics) in enumerate(rows.items())
    ]
    return one.select(F.inline(F.array(*structs)))


def normalize_names(df: DataFrame, order_by: str | None = None) -> DataFrame:
    names = iter(unique_name_list(snake_case_name(c) for c in data_columns(df, order_by)))
    return df.toDF(*[c if c == order_by else next(names) for c in df.columns])


def trim_cells(df: DataFrame, order_by: str | None = None) -> DataFrame:
    texts = set(text_columns(df, order_by))
    return df.select([strip(quoted(c)).alias(c) if c in texts else quoted(c) for c in df.columns])


def count_trimmed(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """(column, changed): cells that trimming changes."""
    return long_form(df, {
        c: {"changed": F.count_if(strip(quoted(c)) != quoted(c))} for c in text_columns(df, order_by)
    })


def _empty(c: str, text: bool, blank_is_empty: bool) -> Column:
    null = quoted(c).isNull()
    return null | is_blank(quoted(c)) if text and blank_is_empty else null


def is_empty_row(df: DataFrame, order_by: str | None = None, blank_is_empty: bool = True) -> Column:
    texts = set(text_columns(df, order_by))
    cond = F.lit(True)
    for c in data_columns(df, order_by):
        cond = cond & _empty(c, c in texts, blank_is_empty)
    return cond


def drop_empty_rows(df: DataFrame, order_by: str | None = None, blank_is_empty: bool = True) -> DataFrame:
    return df.filter(~is_empty_row(df, order_by, blank_is_empty))


def shape(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """(rows, cols) of a table."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "cols", F.lit(len(data_columns(df, order_by))).cast("bigint")
    )


def clean_table(df: DataFrame, order_by: str, blank_is_empty: bool = True) -> DataFrame:
    """Names, whitespace, empty rows, exact duplicates (first one kept)."""
    from .dedup import drop_exact_duplicates

    named = normalize_names(df, order_by)
    full = drop_empty_rows(trim_cells(named, order_by), order_by, blank_is_empty)
    return drop_exact_duplicates(full, order_by)
