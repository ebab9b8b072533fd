"""Sinks: delimited output, manifests, event logs, and reading them back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import pseudonym
from ..functions.text import _col


def write_delimited(df: DataFrame, path: str, delimiter: str = ",", order_by: str | None = None,
                    mode: str = "errorifexists") -> None:
    """UTF-8, LF, header, minimal quoting with doubled quotes.

    With ``order_by`` rows are range-partitioned and sorted, so part files in
    name order hold the table in order; the column itself is not written.
    """
    out = df
    if order_by is not None:
        out = df.repartitionByRange(order_by).sortWithinPartitions(order_by).drop(order_by)
    (out.write.mode(mode)
        .options(header=True, sep=delimiter, escape='"', emptyValue="", lineSep="\n", encoding="UTF-8",
                 ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .csv(path))


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",", infer: bool = True, schema: str | None = None) -> DataFrame:
    """Read delimited output back; a missing or unreadable output is a table without columns and rows.

    Parts are read in their splits, also where cells hold line breaks
    (see ``readback``).  With ``schema`` no pass over the data infers the types.
    """
    from .readback import read_split

    return read_split(spark, path, delimiter, schema=schema, infer=infer)


MANIFEST_DEFAULTS = {
    "rows": "bigint", "cols": "bigint", "changelog": "array<string>", "import_warning": "boolean",
    "repaired_rows": "bigint", "near_dupes_mode": "string", "ignored_cols": "array<string>",
    "near_dupes_count": "bigint", "near_dupe_examples": "array<string>", "detected_delimiter": "string",
    "out_file": "string", "original_file": "string", "original_filename": "string",
    "header_debug_log": "array<string>",
}

_EMPTY = {
    "changelog": "array()", "import_warning": "false", "repaired_rows": "0L", "near_dupes_mode": "''",
    "ignored_cols": "array()", "near_dupes_count": "0L", "near_dupe_examples": "array()",
    "detected_delimiter": "','", "original_filename": "'original.csv'", "header_debug_log": "array()",
}


def manifest_rows(df: DataFrame, job_id: str = "job_id", created_at: Column | None = None) -> DataFrame:
    """Manifest rows: the given columns over the defaults, ``NaN`` stored as null."""
    created = F.current_timestamp() if created_at is None else created_at
    cols = [_col(job_id).alias("job_id"), created.alias("created_at")]
    for name, kind in MANIFEST_DEFAULTS.items():
        default = F.expr(f"cast({_EMPTY.get(name, 'null')} as {kind})")
        if name not in df.columns:
            cols.append(default.alias(name))
            continue
        value = F.col(name)
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(value), value)
        cols.append(F.coalesce(value.cast(kind), default).alias(name))
    return df.select(cols)


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read_manifest(spark: SparkSession, path: str, job_id: str | None = None) -> DataFrame:
    """All manifest rows, or those of a job; an unknown job gives no row."""
    found = spark.read.parquet(path)
    return found if job_id is None else found.filter(F.col("job_id") == job_id)


def log_lines(df: DataFrame, ts: str, event: str, address: str | None = None, fields: Sequence[str] = (),
              keep: Sequence[str] = ()) -> DataFrame:
    """One JSON line per event; the address is stored only as a pseudonym.

    Numbers, booleans and texts keep their kind; other fields are written as text.
    """
    parts = [F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col(event).alias("event")]
    if address is not None:
        parts.append(pseudonym(address).alias("ip_hash"))
    plain = (T.StringType, T.NumericType, T.BooleanType)
    parts += [(F.col(f) if isinstance(df.schema[f].dataType, plain) else F.col(f).cast("string")).alias(f) for f in fields]
    return df.select(*keep, F.to_json(F.struct(*parts)).alias("line"))


def write_log(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("append").text(path)
