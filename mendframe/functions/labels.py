"""Small labelling expressions: addresses, output names, report messages."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import _col, _lit_or_col, strip


def pseudonym(c) -> Column:
    """First 12 hex digits of the SHA-256."""
    return F.substring(F.sha2(_col(c).cast("binary"), 256), 1, 12)


def client_address(forwarded, remote) -> Column:
    """First forwarded address, else the remote address, else ``unknown``."""
    fwd = F.coalesce(_col(forwarded), F.lit(""))
    return (
        F.when(fwd != "", strip(F.substring_index(fwd, ",", 1)))
        .when(F.coalesce(_col(remote), F.lit("")) != "", _col(remote))
        .otherwise(F.lit("unknown"))
    )


def delimiter_label(delimiter) -> Column:
    d = _lit_or_col(delimiter)
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(K.DELIMITER_LABELS.items())])
    return F.coalesce(F.try_element_at(known, d), d)


def output_name(delimiter) -> Column:
    return F.when(_lit_or_col(delimiter) == "\t", F.lit("cleaned.tsv")).otherwise(F.lit("cleaned.csv"))


def accepted_extension(name) -> Column:
    pattern = r"\.(" + "|".join(K.ACCEPTED_EXTENSIONS) + r")$"
    return strip(F.lower(F.coalesce(_col(name), F.lit("")))).rlike(pattern)


def message_class(message) -> Column:
    """``repair`` for a message about a change, ``check`` otherwise."""
    return F.when(strip(message).rlike(K.REPAIR_MESSAGE), F.lit("repair")).otherwise(F.lit("check"))


def is_header_debug(message) -> Column:
    return _col(message).rlike("^(" + "|".join(K.HEADER_DEBUG_PREFIXES) + ")")


def badges(changelog) -> Column:
    """Result badges read from the list of changelog messages."""
    log = _col(changelog)
    return F.struct(
        F.lit("UTF-8").alias("encoding_label"),
        F.when(F.exists(log, lambda m: F.contains(m, F.lit("Normalized numeric formats"))), F.lit("Normalized"))
        .otherwise(F.lit("Unchanged")).alias("numbers_label"),
        F.when(F.exists(log, lambda m: F.contains(m, F.lit("Header detected"))), F.lit("Auto-detected"))
        .otherwise(F.lit("First row")).alias("header_label"),
    )
