"""Cleaning of rows whose cells are an array, for many files at once.

Files differ in their headers, so a row is (file, _row_id, cells) and the
header is one row per file.  All files go through the same few jobs, whatever
the number of distinct headers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import names as N
from ..functions.compare import compare_text
from ..functions.numbers import parse_number
from ..functions.text import is_blank, strip_cells


def header_rows(df: DataFrame, raw_header: Column) -> DataFrame:
    """Add ``header`` (clean unique names), ``width`` and ``ignored`` flags."""
    return (
        df.withColumn("raw_header", raw_header)
        .withColumn("width", F.size("raw_header"))
        .withColumn("header", N.unique_names(N.snake_names(F.col("raw_header"))))
        .withColumn("ignored", F.transform("header", N.is_ignorable_name))
    )


def trimmed_rows(df: DataFrame, blank_is_empty: bool) -> DataFrame:
    """(file, _row_id, _repaired, cells, too_long, too_short, trimmed, is_empty): rows with trimmed cells.

    Input: (file, ln, text, cells, too_long, too_short).
    """
    trimmed = strip_cells("cells", F.col("text"))
    changed = F.when(F.col("cells") == F.col("_trimmed"), 0).otherwise(
        F.size(F.filter(F.zip_with("cells", "_trimmed", lambda a, b: a != b), lambda x: x)))
    empty = F.forall("_trimmed", lambda c: c == "") if blank_is_empty else F.lit(False)
    return df.withColumn("_trimmed", trimmed).select(
        "file", F.col("ln").alias("_row_id"), (F.col("too_long") | F.col("too_short")).alias("_repaired"),
        F.col("_trimmed").alias("cells"), "too_long", "too_short", changed.alias("trimmed"), empty.alias("is_empty"))


def packed_digest(file: Column, cells: Column) -> Column:
    """SHA-256 of a file name and an array of cells, each written with its length."""
    packed = F.array_join(F.transform(cells, lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)), "", "-")
    return F.unhex(F.sha2(F.concat(F.octet_length(file).cast("string"), F.lit(":"), file, packed).cast("binary"), 256))


def exact_keys(rows: DataFrame) -> DataFrame:
    """(file, _row_id, key) of rows that aren't empty: narrow, so the rows themselves need no shuffle."""
    return rows.filter("NOT is_empty").select("file", "_row_id", packed_digest(F.col("file"), F.col("cells")).alias("key"))


def duplicate_rows(keys: DataFrame, groups: DataFrame) -> DataFrame:
    """(file, _row_id) of all rows but the first of each group; ``groups`` holds those with several rows."""
    return keys.join(groups.select("key", "kept_id"), "key").filter(F.col("_row_id") != F.col("kept_id")).select("file", "_row_id")


def clean_counts(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Counters per file over trimmed rows and the groups of their keys."""
    every = rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("rows_in"), F.sum("trimmed").alias("trimmed"),
        F.count_if("too_long").alias("too_long"), F.count_if("too_short").alias("too_short"),
        F.count_if("is_empty").alias("empty_rows"))
    kept = groups.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("n") - 1).alias("duplicate_rows"))
    return every.join(kept, "file", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("rows", "duplicate_rows")})


def numeric_positions(rows: DataFrame) -> DataFrame:
    """(file, numeric, lossy): positions of numeric columns, and cells they lose.

    Counters are combined per task by (file, position) before the shuffle.
    """
    cells = rows.select("file", F.posexplode("cells").alias("pos", "cell")).filter(~is_blank("cell"))
    counted = cells.select("file", "pos", parse_number("cell").isNotNull().alias("ok")).groupBy("file", "pos").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("ok"))
    fit = counted.filter((F.col("n") >= K.NUMERIC_MIN_VALUES) & (F.col("ok") / F.col("n") >= K.NUMERIC_MIN_SHARE))
    return fit.groupBy("file").agg(
        F.array_sort(F.collect_list("pos")).alias("numeric"), F.sum(F.col("n") - F.col("ok")).alias("lossy_cells"))


def number_text(value: Column) -> Column:
    """Shortest decimal text of a double, with ``.0`` on whole numbers."""
    plain = value.cast("string")
    long_form = F.regexp_replace(F.rtrim(plain.cast("decimal(38,18)").cast("string"), F.lit("0")), r"\.$", ".0")
    return F.when(F.contains(plain, F.lit("E")) & (F.abs(value) < 1e16) & (F.abs(value) >= 1e-4), long_form).otherwise(plain)


def convert_numbers(rows: DataFrame) -> DataFrame:
    """Rewrite the cells at ``numeric`` positions; unparseable ones become empty."""
    def cell(c, i):
        return F.when(F.array_contains("numeric", i), F.coalesce(number_text(parse_number(c)), F.lit(""))).otherwise(c)

    return rows.withColumn("cells", F.when(F.size("numeric") > 0, F.transform("cells", cell)).otherwise(F.col("cells")))


def near_duplicate_keys(rows: DataFrame) -> DataFrame:
    """(file, _row_id, key): digest of the file and its compared cells; rows of
    files with nothing to compare are left out."""
    compared = F.filter(
        F.transform("cells", lambda c, i: F.when(~F.get("ignored", i), compare_text(c))), lambda c: c.isNotNull())
    return rows.filter(F.exists("ignored", lambda x: ~x)).select(
        "file", "_row_id", packed_digest(F.col("file"), compared).alias("key"))


def key_groups(keys: DataFrame) -> DataFrame:
    return keys.groupBy("key").agg(F.any_value("file").alias("file"), F.min("_row_id").alias("kept_id"), F.count(F.lit(1)).alias("n"))


def near_duplicate_pairs(keys: DataFrame, groups: DataFrame, n_files: int, limit: int = K.NEAR_DUP_EXAMPLES) -> DataFrame:
    """(file, kept_id, removed_id): the first pairs of each file.

    Spark prunes both rankings to the first rows of each task before the
    shuffle, so a file with most of the rows does not gather them.
    """
    from ..sources.files import BROADCAST_ROWS

    by_kept = Window.partitionBy("file").orderBy("kept_id")
    first = groups.filter("n > 1").withColumn("_r", F.row_number().over(by_kept)).filter(F.col("_r") <= limit)
    side = first.select("key", "kept_id")
    side = F.broadcast(side) if n_files * limit <= BROADCAST_ROWS else side
    pairs = keys.join(side, "key").filter(F.col("_row_id") != F.col("kept_id"))
    by_pair = Window.partitionBy("file").orderBy("kept_id", "_row_id")
    return pairs.withColumn("_r", F.row_number().over(by_pair)).filter(F.col("_r") <= limit).select(
        "file", "kept_id", F.col("_row_id").alias("removed_id"))
