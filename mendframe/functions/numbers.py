"""Locale-tolerant number parsing as one column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as K
from .text import _col, let, strip


def is_negated(text: Column) -> Column:
    return F.startswith(text, F.lit("(")) & F.endswith(text, F.lit(")"))


def bare_number(text: Column) -> Column:
    """Stripped text without outer parentheses and currency signs."""
    inner = F.when(is_negated(text), strip(F.substring(text, F.lit(2), F.length(text) - 2))).otherwise(text)
    return strip(F.translate(inner, "$€£", ""))


def bare_value(text: Column, bare: Column) -> Column:
    plain = F.when(bare.rlike(K.EURO_NUMBER), F.translate(bare, ",. ", ".")).when(
        bare.rlike(K.US_NUMBER), F.replace(bare, F.lit(","), F.lit(""))
    )
    value = plain.try_cast("double")
    return F.when(is_negated(text), -value).otherwise(value)


def parse_number(c) -> Column:
    """Double value of an EU or US formatted number, null when it is neither.

    Outer parentheses negate, currency signs are dropped, the EU reading
    (``1.234,56``) is tried before the US reading (``1,234.56``).
    """
    return let(strip(c), lambda text: let(bare_number(text), lambda bare: bare_value(text, bare)))


def with_parsed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add parsed columns (new name -> source) to a table.

    Each step is a projection of its own, so for wide tables no step is
    written out again inside the next one.
    """
    step = df.withColumns({f"_text_{new}": strip(F.col(f"`{old}`")) for new, old in columns.items()})
    step = step.withColumns({f"_bare_{new}": bare_number(F.col(f"`_text_{new}`")) for new in columns})
    step = step.withColumns({new: bare_value(F.col(f"`_text_{new}`"), F.col(f"`_bare_{new}`")) for new in columns})
    return step.drop(*[f"_{part}_{new}" for part in ("text", "bare") for new in columns])


def is_plain_number(c) -> Column:
    return _col(c).rlike(K.PLAIN_NUMBER)
