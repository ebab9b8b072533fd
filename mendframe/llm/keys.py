"""Small helpers of several operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few dozen bytes up to which a written table is broadcast (some 40 MB at most); a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000


def text_key(text: str) -> Column:
    """16 bytes that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def small(written: DataFrame) -> DataFrame:
    """A written table of narrow rows, to be broadcast if its count allows it."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


#: Most keys that ``lookup`` broadcasts: a key is hot above ``max(MIN_HOT_ROWS, rows / HOT_KEYS)`` rows.
HOT_KEYS = 100_000
MIN_HOT_ROWS = 10_000


def lookup(big: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """``big`` left-joined with ``small`` (at most one row per key), safe for keys that hold much of ``big``.

    Keys with more rows than the bound are hot: there are at most ``HOT_KEYS``
    of them, so their rows of ``small`` are broadcast and their rows of ``big``
    stay where they are.  All other keys are joined by a shuffle in which no
    key holds more than the bound.  Rows with a null key match nothing and are
    not shuffled.
    """
    total = big.count()
    bound = max(MIN_HOT_ROWS, -(-total // HOT_KEYS))
    hot = big.filter(F.col(key).isNotNull()).groupBy(key).count().filter(F.col("count") > bound).select(key)
    hot_small = F.broadcast(small.join(F.broadcast(hot), key))
    extra = [F.lit(None).cast(f.dataType).alias(f.name) for f in small.schema.fields if f.name != key]
    keyed = big.filter(F.col(key).isNotNull())
    hot_rows = keyed.join(F.broadcast(hot), key).join(hot_small, key, "left")
    cold_rows = keyed.join(F.broadcast(hot), key, "left_anti").join(small, key, "left")
    nulls = big.filter(F.col(key).isNull()).select(*big.columns, *extra)
    cols = [*big.columns, *(f.name for f in small.schema.fields if f.name != key)]
    return hot_rows.select(*cols).unionByName(cold_rows.select(*cols)).unionByName(nulls.select(*cols))


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of at most ``most`` rows in the jobs run inside; a batch is held by the JVM and by the worker at once."""
    now = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(int(now), most) if int(now) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, now)
