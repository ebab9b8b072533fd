"""Rounding by the exact binary value of a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col


def round2(c) -> Column:
    """Two decimals; a double that only prints like a tie is rounded by its true side.

    Spark's ``round`` works on the printed decimals, so 4.725 (stored slightly
    below) would go up.  Here the rounding error of ``x * 100`` decides.
    """
    x = _col(c)
    y = x * 100.0
    down = F.floor(y).cast("double")
    high = x * 134217729.0 - (x * 134217729.0 - x)  # upper half of the mantissa
    error = (high * 100.0 - y) + (x - high) * 100.0
    near_tie = F.when(error > 0, down + 1).when(error < 0, down).otherwise(F.rint(y))
    return F.when(F.abs(x) == float("inf"), x).when(y - down == 0.5, near_tie / 100.0).otherwise(F.rint(y) / 100.0)


def fixed2(c) -> Column:
    """Text with two decimals."""
    x = _col(c)
    return F.when(F.abs(x) == float("inf"), F.lit("inf")).otherwise(F.format_string("%.2f", round2(x)))
