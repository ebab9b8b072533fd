"""Admission of input files: size, extension, binary content, limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.labels import accepted_extension
from ..functions.text import _col


def is_binary(raw, sniff_bytes: int = K.BINARY_SNIFF_BYTES) -> Column:
    """True when a NUL byte is among the first bytes of a binary column."""
    return F.contains(F.substring(_col(raw).cast("binary"), 1, sniff_bytes), F.unhex(F.lit("00")))


def admission_verdict(name=None, n_bytes=None, raw_head=None, n_rows=None, is_empty=None, n_cols=None,
                      rate_limited=None, max_bytes: int | None = None, max_rows: int | None = None,
                      max_cols: int | None = None, binary=None) -> Column:
    """First reason to reject a file, null when it is accepted.

    Order: too_large, rate_limited, extension, binary, too_many_rows, empty,
    too_many_columns.  A fact that is not given, or a limit of None, never rejects.
    """
    checks = []
    if n_bytes is not None and max_bytes is not None:
        checks.append(F.when(_col(n_bytes) > max_bytes, F.lit("too_large")))
    if rate_limited is not None:
        checks.append(F.when(_col(rate_limited), F.lit("rate_limited")))
    if name is not None:
        checks.append(F.when(~accepted_extension(name), F.lit("extension")))
    if raw_head is not None:
        checks.append(F.when(is_binary(raw_head), F.lit("binary")))
    if binary is not None:
        checks.append(F.when(_col(binary), F.lit("binary")))
    if n_rows is not None and max_rows is not None:
        checks.append(F.when(_col(n_rows) > max_rows, F.lit("too_many_rows")))
    if is_empty is not None:
        checks.append(F.when(_col(is_empty), F.lit("empty")))
    if n_cols is not None and max_cols is not None:
        checks.append(F.when(_col(n_cols) > max_cols, F.lit("too_many_columns")))
    return F.coalesce(*checks) if checks else F.lit(None).cast("string")
