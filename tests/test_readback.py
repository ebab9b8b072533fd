"""Delimited output read back in splits, against Spark's whole-part CSV reader."""

import pytest
from pyspark.sql import functions as F

from mendframe.sources import sinks
from mendframe.sources.readback import read_records_of
from mendframe.sources.workspace import Workspace


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_parts_with_line_breaks_are_read_in_many_splits(spark, tmp_path, small_splits):
    rows = [(i, f"line {i}\nnext \"{i}\"" if i % 3 == 0 else f"plain;{i}", None if i % 7 == 0 else i * 1.5, i % 2 == 0)
            for i in range(300)]
    df = spark.createDataFrame(rows, "id long, note string, amount double, even boolean")
    out = str(tmp_path / "out")
    sinks.write_delimited(df.coalesce(1), out, delimiter=";")
    ws = Workspace(spark)
    recs = read_records_of(spark, out, ";", ws)
    assert recs.filter("ln > 0").count() == 300
    assert spark.read.parquet(f"{ws.path}/readback_segments").select("blk").distinct().count() > 5   # one part, many splits
    got = sinks.read_delimited(spark, out, delimiter=";")
    want = spark.read.options(header=True, sep=";", multiLine=True, escape='"', inferSchema=True).csv(out)
    assert [f.name for f in got.schema.fields] == ["id", "note", "amount", "even"]
    norm = lambda d: sorted(tuple(r) for r in d.select(F.col("id").cast("long"), "note", F.col("amount").cast("double"),
                                                             F.col("even").cast("boolean")).collect())
    assert norm(got) == norm(want)
    typed = sinks.read_delimited(spark, out, delimiter=";", schema="id long, note string, amount double, even boolean")
    assert norm(typed) == norm(want)


def test_missing_and_empty_outputs(spark, tmp_path):
    assert sinks.read_delimited(spark, str(tmp_path / "none")).columns == []
    empty = spark.createDataFrame([], "a long, b string")
    sinks.write_delimited(empty, str(tmp_path / "empty"))
    assert sinks.read_delimited(spark, str(tmp_path / "empty")).count() == 0
