"""Changelog of a run, one ordered list of messages per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.detect import delimiter_message
from ..functions.messages import counted, grouped, message, shown_delimiter


def structural_messages() -> list[Column]:
    multi_line = F.col("stitched_records") > 0
    return [
        F.when(F.col("has_cr"), message("newlines")),
        F.when(F.col("encoding") == "utf-8", message("encoding_utf8")).otherwise(message("encoding_other", "encoding")),
        F.when(multi_line, message("stitch_merged", "physical_lines", "logical_lines", "stitched_records", "max_physical_per_record"))
        .otherwise(message("stitch_none")),
        F.when(multi_line, message("stitch_fixed", "stitched_records")).otherwise(message("stitch_check")),
        F.when(F.col("synthetic").isNotNull(), message("synthetic")),
    ]


def import_messages() -> list[Column]:
    long, short = F.col("too_long") > 0, F.col("too_short") > 0
    return [
        F.when(long, message("import_too_long", grouped("too_long"))),
        F.when(short, message("import_too_short", grouped("too_short"))),
        F.when(~long & ~short, message("import_consistent")),
    ]


def cleaning_messages(normalize_numbers: bool) -> list[Column]:
    steps = [
        F.when(F.col("header") != F.col("raw_header"), message("names")),
        F.when(F.col("width") == 0, message("trim_no_columns")).otherwise(counted("trimmed", "trim_changed", "trim_none")),
        counted("empty_rows", "empty_removed", "empty_none"),
        counted("duplicate_rows", "duplicates_removed", "duplicates_none"),
    ]
    if normalize_numbers:
        converted = F.size("numeric")
        steps.append(F.when(converted > 0, message("numbers_converted", converted)).otherwise(message("numbers_none")))
    return steps


def near_duplicate_messages(mode: str) -> list[Column]:
    if not mode:
        return []
    names = F.filter(F.transform("header", lambda h, i: F.when(F.get("ignored", i), h)), lambda h: h.isNotNull())
    listed = F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise(F.lit("(none)"))
    return [
        counted("near_dupes", "near_removed" if mode == "remove" else "near_preview", "near_none"),
        message("near_rule", listed),
    ]


def with_changelog(df: DataFrame, normalize_numbers: bool, near_dupes: str, wrote_output: bool = True) -> DataFrame:
    """Add ``changelog``, ``repairs`` and ``checks`` (lists) and ``header_debug_log``."""
    user = F.filter("header_log", lambda m: ~L.is_header_debug(m))
    parts = [F.array(*structural_messages(), delimiter_message(F.col("choice"))), user,
             F.array(*import_messages(), *cleaning_messages(normalize_numbers), *near_duplicate_messages(near_dupes),
                     *([message("output", shown_delimiter("delimiter"))] if wrote_output else []))]
    logged = df.withColumn("changelog", F.filter(F.concat(*parts), lambda m: m.isNotNull()))
    return logged.withColumns({
        "header_debug_log": F.filter("header_log", L.is_header_debug),
        "repairs": F.filter("changelog", lambda m: L.message_class(m) == "repair"),
        "checks": F.filter("changelog", lambda m: L.message_class(m) == "check"),
    })


def changelog_rows(df: DataFrame) -> DataFrame:
    """(file, seq, class, message): the changelogs in long form."""
    rows = df.select("file", F.posexplode("changelog").alias("pos", "message"))
    return rows.select("file", (F.col("pos") + 1).alias("seq"), L.message_class("message").alias("class"), "message")
