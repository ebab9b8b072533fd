"""Exact and near-duplicate rows, first one kept.

Spark tables have no order, so "first" means the smallest value of an ordering
column, which is meant to be unique and not null.  Nulls come last; rows that
tie with the first of their group stay in the near-duplicate operators, and
exact duplicates keep one of them.  No operator gathers the rows of a duplicate group: groups
are reduced by aggregates with map-side combine, so a group of copies that
holds a third of the table costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.compare import compare_keys, row_digest, value_keys
from ..functions.names import ignorable_columns
from ..sources.workspace import Workspace
from .clean import data_columns, quoted

# At most this many groups are treated as hot; their keys are broadcast
# (1,000 digests of 32 bytes), and a group outside them holds under N/1,000 rows.
HOT_GROUPS = 1000

# Rows of a written key table (some 60 bytes each) up to which it is broadcast; it only picks the join.
BROADCAST_ROWS = 500_000

# Exact duplicates: rows whose compared values take at most this many bytes on average are reduced by one aggregate
# (map-side combine, groups shuffled at their width); wider rows by 32-byte digests that leave the rows in place.
# The width is measured on the first WIDTH_SAMPLE_ROWS rows; both plans give the same rows.
NARROW_ROW_BYTES = 256
WIDTH_SAMPLE_ROWS = 10_000


def _joinable(written: DataFrame) -> DataFrame:
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written.hint("shuffle_hash")


def drop_exact_duplicates(df: DataFrame, order_by: str) -> DataFrame:
    """The first row of each set of rows that agree in all data columns.

    Rows are compared by a digest, so that only 40 bytes per row are shuffled
    and the wide rows are left in place.  Columns that have no plain text form
    (arrays, maps, structs) make it one aggregate over whole rows.
    """
    data = data_columns(df, order_by)
    keys = value_keys(df, data)
    if keys is None or not data:
        kept = df.groupBy([quoted(c) for c in data]).agg(F.min(quoted(order_by)).alias(order_by))
        return kept.select([quoted(c) for c in df.columns])
    if mean_width(df, keys) <= NARROW_ROW_BYTES:
        return first_by_aggregate(df, keys, data, order_by)
    digest = row_digest(keys)
    rows, groups = _written(df, df.select(digest.alias("key"), quoted(order_by).alias("row_id")))
    dropped = dropped_rows(rows, groups)
    left = _without_dropped(df, digest, order_by, dropped)
    total = groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    if total["rows"] - dropped.count() > total["groups"]:  # rows that also tie in the ordering column
        left = left.dropDuplicates(data)
    return left


def mean_width(df: DataFrame, keys: Sequence) -> float:
    """Mean bytes of the compared values in the first ``WIDTH_SAMPLE_ROWS`` rows (0 for an empty table)."""
    size = sum((F.coalesce(F.octet_length(k.cast("string")), F.lit(0)) for k in keys), F.lit(0))
    got = df.limit(WIDTH_SAMPLE_ROWS).agg(F.avg(size)).first()[0]
    return float(got or 0)


def first_by_aggregate(df: DataFrame, keys: Sequence, data: Sequence[str], order_by: str) -> DataFrame:
    """The same rows as the digest plan, by one aggregate: per group of equal keys the row of the smallest ordering
    value, nulls last; of rows that tie there, one."""
    first = F.min(F.struct(F.col(f"`{order_by}`").isNull().alias("_null"), quoted(order_by).alias("_order"),
                           *[quoted(c).alias(f"_c{i}") for i, c in enumerate(data)]))
    kept = df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(first.alias("_first"))
    named = {order_by: F.col("_first._order"), **{c: F.col(f"_first._c{i}") for i, c in enumerate(data)}}
    return kept.select([named[c].alias(c) for c in df.columns])


def compared_columns(df: DataFrame, order_by: str, compare_cols: Sequence[str] | None = None) -> list[str]:
    if compare_cols is not None:
        return list(compare_cols)
    data = data_columns(df, order_by)
    ignored = set(ignorable_columns(data))
    return [c for c in data if c not in ignored]


def keyed_rows(df: DataFrame, order_by: str, compare_cols: Sequence[str] | None = None) -> DataFrame | None:
    """(key, row_id) per row, or None when there is nothing to compare."""
    columns = compared_columns(df, order_by, compare_cols)
    if not columns:
        return None
    return df.select(row_digest(compare_keys(df, columns)).alias("key"), quoted(order_by).alias("row_id"))


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """(key, kept_id, n) per group of equal keys."""
    return rows.groupBy("key").agg(F.min("row_id").alias("kept_id"), F.count(F.lit(1)).alias("n"))


def dropped_rows(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, row_id) of all rows but the first of each group, as a written table.

    Both inputs must be written tables.  Rows that tie with the first one, and
    all rows of a group without any ordering value, stay.
    """
    repeated = Workspace(rows.sparkSession).save(groups.filter("n > 1").select("key", "kept_id"), "repeated")
    found = rows.join(_joinable(repeated), "key").filter(~F.col("row_id").eqNullSafe(F.col("kept_id")))
    return Workspace(rows.sparkSession).save(found.select("key", "row_id").distinct(), "dropped")


def _matches(digest, order_by: str):
    return (digest == F.col("_mf_key")) & F.col(f"`{order_by}`").eqNullSafe(F.col("_mf_row"))


def _without_dropped(df: DataFrame, digest, order_by: str, dropped: DataFrame) -> DataFrame:
    """Anti join by key and row id, whatever the number of dropped rows; only the kind of join depends on it."""
    gone = _joinable(dropped.select(F.col("key").alias("_mf_key"), F.col("row_id").alias("_mf_row")))
    return df.join(gone, _matches(digest, order_by), "left_anti")


def _written(df: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys (40 bytes per row) and groups as written tables: several steps read them."""
    ws = Workspace(df.sparkSession)
    rows = ws.save(rows, "near_keys")
    return rows, ws.save(duplicate_groups(rows), "near_groups")


def mark_near_duplicates(df: DataFrame, order_by: str, compare_cols: Sequence[str] | None = None) -> DataFrame:
    """Add ``is_near_dup``: true for all but the first row of each group."""
    rows = keyed_rows(df, order_by, compare_cols)
    if rows is None:
        return df.withColumn("is_near_dup", F.lit(False))
    dropped = dropped_rows(*_written(df, rows))
    gone = _joinable(dropped.select(F.col("key").alias("_mf_key"), F.col("row_id").alias("_mf_row"), F.lit(True).alias("_mf_found")))
    digest = row_digest(compare_keys(df, compared_columns(df, order_by, compare_cols)))
    marked = df.join(gone, _matches(digest, order_by), "left")
    return marked.select([quoted(c) for c in df.columns] + [F.col("_mf_found").isNotNull().alias("is_near_dup")])


def drop_near_duplicates(df: DataFrame, order_by: str, compare_cols: Sequence[str] | None = None) -> DataFrame:
    rows = keyed_rows(df, order_by, compare_cols)
    if rows is None:
        return df
    digest = row_digest(compare_keys(df, compared_columns(df, order_by, compare_cols)))
    return _without_dropped(df, digest, order_by, dropped_rows(*_written(df, rows)))


def count_near_duplicates(df: DataFrame, order_by: str, compare_cols: Sequence[str] | None = None) -> DataFrame:
    rows = keyed_rows(df, order_by, compare_cols)
    if rows is None:
        return df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("near_dupes"))
    return duplicate_groups(rows).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("near_dupes"))


def near_duplicate_examples(df: DataFrame, order_by: str, limit: int = K.NEAR_DUP_EXAMPLES,
                            compare_cols: Sequence[str] | None = None) -> DataFrame:
    """The first ``limit`` (kept, removed) row pairs, as two structs.

    Ordered by kept, then removed row.  ``limit`` groups are enough to give
    ``limit`` pairs, so only that many keys and pairs are ever broadcast.  The
    keys are written once (40 bytes per row) and the wide rows are read once more.
    """
    rows = keyed_rows(df, order_by, compare_cols)
    row = F.struct(*[quoted(c) for c in df.columns])
    if rows is None:
        return df.limit(0).select(row.alias("kept"), row.alias("removed"))
    rows, groups = _written(df, rows)
    first = groups.filter("n > 1").orderBy("kept_id").limit(limit)
    pairs = (
        rows.join(F.broadcast(first), "key")
        .filter(F.col("row_id") != F.col("kept_id"))
        .orderBy("kept_id", "row_id").limit(limit)
    )
    roles = pairs.select("kept_id", F.col("row_id").alias("removed_id"), F.inline(F.array(
        F.struct(F.col("kept_id").alias("_id"), F.lit(True).alias("is_kept")),
        F.struct(F.col("row_id").alias("_id"), F.lit(False).alias("is_kept")),
    )))
    found = df.select(quoted(order_by).alias("_id"), row.alias("_row")).join(F.broadcast(roles), "_id")
    both = found.groupBy("kept_id", "removed_id").agg(
        F.any_value(F.when(F.col("is_kept"), F.col("_row")), F.lit(True)).alias("kept"),
        F.any_value(F.when(~F.col("is_kept"), F.col("_row")), F.lit(True)).alias("removed"),
    )
    return both.orderBy("kept_id", "removed_id").select("kept", "removed")


def comparison_rows(examples: DataFrame, mode: str = "remove") -> DataFrame:
    """Each example as two rows with a ``status`` column."""
    label = "Would remove" if mode == "preview" else "Removed"
    cols = examples.schema["kept"].dataType.names
    # The input is a handful of example pairs, so one partition is right.
    order = Window.partitionBy(F.lit(1)).orderBy("kept", "removed")
    numbered = examples.withColumn("example", F.row_number().over(order).cast("bigint"))

    def side(status: str, part: str):
        return F.struct(F.lit(status).alias("status"), *[F.col(f"{part}.`{c}`").alias(c) for c in cols])

    return numbered.select("example", F.inline(F.array(side("Kept", "kept"), side(label, "removed"))))


def group_occurrences(df: DataFrame, order_by: str, compare_cols: Sequence[str] | None = None) -> DataFrame:
    """(kept_id, row_id, n): every row with the first row of its group.

    Rows of the largest groups meet their group through a broadcast of those
    few keys; all others through a shuffle in which no key is large.  Keys and
    groups are written once, since both paths read them.
    """
    rows = keyed_rows(df, order_by, compare_cols)
    if rows is None:
        raise ValueError("no columns to compare")
    rows, groups = _written(df, rows)
    hot = groups.orderBy(F.desc("n"), "key").limit(HOT_GROUPS)
    in_hot = rows.join(F.broadcast(hot), "key")
    cold = rows.join(F.broadcast(hot.select("key")), "key", "left_anti").join(groups, "key")
    return in_hot.unionByName(cold).select("kept_id", "row_id", "n")
