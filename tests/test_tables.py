"""Table operators on small fixtures, and plans of the core operators."""

import random

import pytest
from pyspark.sql import functions as F

from mendframe.functions.names import snake_case, snake_case_name, unique_name_list
from mendframe.functions.rounding import fixed2, round2
from mendframe.operators import clean as C
from mendframe.operators import dedup as D
from mendframe.operators import events as V
from mendframe.operators import numeric as N
from mendframe.plans.registry import QUERIES

NEAR = [(0, "1", "2024-01-01", "Acme  Inc", "5", "10"), (1, "2", "2024-01-02", "acme inc", "5", "20"),
        (2, "1", "2024-01-01", "Acme  Inc", "5", "10"), (3, "3", "2024-01-03", "Beta", "7", "30")]


@pytest.fixture
def near(spark):
    return spark.createDataFrame(NEAR, "_row_id long, id string, date string, name string, amount string, balance string")


def ids(df):
    return sorted(r["_row_id"] for r in df.collect())


def test_exact_then_near(near):
    exact = D.drop_exact_duplicates(near, "_row_id")
    assert ids(exact) == [0, 1, 3]
    mask = {r["_row_id"]: r["is_near_dup"] for r in D.mark_near_duplicates(exact, "_row_id").collect()}
    assert mask == {0: False, 1: True, 3: False}
    assert ids(D.drop_near_duplicates(exact, "_row_id")) == [0, 3]
    assert D.count_near_duplicates(exact, "_row_id").first()[0] == 1
    ex = D.near_duplicate_examples(exact, "_row_id").collect()
    assert [(e.kept["name"], e.removed["name"]) for e in ex] == [("Acme  Inc", "acme inc")]
    rows = D.comparison_rows(D.near_duplicate_examples(exact, "_row_id")).collect()
    assert [r["status"] for r in rows] == ["Kept", "Removed"]


def test_nothing_to_compare(spark):
    df = spark.createDataFrame([(0, "1"), (1, "1")], "_row_id long, user_id string")
    assert D.count_near_duplicates(df, "_row_id").first()[0] == 0
    assert ids(D.drop_near_duplicates(df, "_row_id")) == [0, 1]
    assert not any(r["is_near_dup"] for r in D.mark_near_duplicates(df, "_row_id").collect())


@pytest.mark.parametrize("broadcast_ids", [0, 1_000_000])
def test_groups_with_a_hot_key(spark, monkeypatch, broadcast_ids):
    monkeypatch.setattr(D, "HOT_GROUPS", 2)
    monkeypatch.setattr(D, "BROADCAST_ROWS", broadcast_ids)
    rng = random.Random(4)
    data = [(i, "hot" if rng.random() < 0.4 else f"k{rng.randrange(40)}", None if rng.random() < 0.1 else rng.randrange(2)) for i in range(800)]
    df = spark.createDataFrame(data, "_row_id long, name string, n int")
    want = {}
    for i, a, b in data:
        want.setdefault((a, b), []).append(i)
    expect = sorted((g[0], i, len(g)) for g in want.values() for i in g)
    got = sorted((r.kept_id, r.row_id, r.n) for r in D.group_occurrences(df, "_row_id").collect())
    assert got == expect
    assert D.count_near_duplicates(df, "_row_id").first()[0] == 800 - len(want)
    kept = sorted(g[0] for g in want.values())
    assert ids(D.drop_near_duplicates(df, "_row_id")) == kept
    assert ids(D.mark_near_duplicates(df, "_row_id").filter("NOT is_near_dup")) == kept


@pytest.mark.parametrize("cells,eligible", [
    (["1", "2", "3", "4"], False), (["1", "2", "3", "4", "5"], True), (["1", "2", "3", "4", "5", "6", "x"], True),
    (["1", "2", "3", "4", "5", "x"], False), (["1", "2", "3", "4", "5", " ", ""], True), (["", " "], False),
])
def test_numeric_eligibility(spark, cells, eligible):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "_row_id long, v string")
    assert N.numeric_eligibility(df, "_row_id").first()["eligible"] is eligible
    assert dict(N.normalize_numbers(df, "_row_id").dtypes)["v"] == ("double" if eligible else "string")


def test_normalize_options(spark):
    df = spark.createDataFrame([(i, str(i), "x" if i == 6 else "1,5") for i in range(7)], "_row_id long, user_id string, v string")
    assert dict(N.normalize_numbers(df, "_row_id").dtypes) == {"_row_id": "bigint", "user_id": "double", "v": "double"}
    assert dict(N.normalize_numbers(df, "_row_id", exclude_ignored=True).dtypes)["user_id"] == "string"
    assert dict(N.normalize_numbers(df, "_row_id", on_unparseable="skip_column").dtypes)["v"] == "string"


def test_clean_table(spark):
    df = spark.createDataFrame([(0, " a ", "x"), (1, "a", "x "), (2, " ", ""), (3, None, None), (4, "b", None)],
                               "_row_id long, ` My Name ` string, `my-name` string")
    out = C.clean_table(df, "_row_id")
    assert out.columns == ["_row_id", "my_name", "myname"]
    assert ids(out) == [0, 4]
    assert ids(C.drop_empty_rows(df, "_row_id", blank_is_empty=False)) == [0, 1, 2, 4]
    assert {r["column"]: r["changed"] for r in C.count_trimmed(df, "_row_id").collect()} == {" My Name ": 2, "my-name": 1}
    again = C.clean_table(out, "_row_id")
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, out.collect()), key=str)


def test_name_rules_agree(spark):
    raw = ["  Été—Prix (€) No² ", "__A  b__", "()", "a-b c", "Tab\tName", "x y", "ÀB_ c"]
    df = spark.createDataFrame([(r,) for r in raw], "n string")
    assert [r[0] for r in df.select(snake_case("n")).collect()] == [snake_case_name(r) for r in raw]
    assert unique_name_list(["a", "a", "a_2", "a"]) == ["a", "a_2", "a_2_2", "a_3"]


def test_rounding_is_exact(spark):
    rng = random.Random(9)
    xs = [k / 200 for k in range(-2000, 2000, 3)] + [rng.uniform(-9, 9) for _ in range(500)] + [0.125, 2.675, 1.005, 4.725]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select(round2("x").alias("r"), fixed2("x").alias("t")).collect()
    assert [g.r for g in got] == [round(x, 2) for x in xs]
    assert [float(g.t) for g in got] == [float(f"{x:.2f}") for x in xs]


NATIVE = ["stitch_records", "tokenize_records", "lenient_parse", "delimiter_choice", "header_choice", "strip_preamble",
          "normalize_numbers", "clean_table", "near_dups_removed_documents", "near_dup_mask_documents", "exact_dedup_documents"]


@pytest.mark.parametrize("name", NATIVE)
def test_core_plans_stay_in_the_jvm(spark, sf, name):
    import __spark_entry__  # noqa: F401

    plan = QUERIES[name].run(spark, sf)._jdf.queryExecution().executedPlan().toString()
    for node in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan
    if name.startswith("near_dup"):
        assert "Exchange hashpartitioning" not in plan  # few duplicates: wide rows stay in place
    if name in ("stitch_records", "tokenize_records", "lenient_parse", "delimiter_choice", "header_choice", "strip_preamble"):
        assert "Exchange" not in plan


@pytest.mark.parametrize("narrow", [-1, 1_000_000])
@pytest.mark.parametrize("threshold", [0, 1_000_000])
def test_null_and_repeated_order_values(spark, monkeypatch, threshold, narrow):
    """Neither the size nor the kind of join nor the plan chosen by row width decides what stays."""
    monkeypatch.setattr(D, "BROADCAST_ROWS", threshold)
    monkeypatch.setattr(D, "NARROW_ROW_BYTES", narrow)
    data = [(None, "a"), (1, "A "), (2, "a"), (None, "b"), (None, "b"), (3, "c"), (3, "C"), (3, "d"), (5, "D"), (5, "e")]
    df = spark.createDataFrame(data, "_row_id long, name string")
    near = sorted(map(str, D.drop_near_duplicates(df, "_row_id").collect()))
    marked = D.mark_near_duplicates(df, "_row_id")
    assert near == sorted(map(str, marked.filter("NOT is_near_dup").drop("is_near_dup").collect()))
    # the first of each group, with ties: (1, A), both nulls of b, both threes of c, (3, d), (5, e)
    assert sorted((r._row_id or 0, r.name) for r in D.drop_near_duplicates(df, "_row_id").collect()) == [
        (0, "b"), (0, "b"), (1, "A "), (3, "C"), (3, "c"), (3, "d"), (5, "e")]
    exact = D.drop_exact_duplicates(df.unionByName(df), "_row_id").collect()
    assert sorted((r._row_id or 0, r.name) for r in exact) == [
        (0, "b"), (1, "A "), (2, "a"), (3, "C"), (3, "c"), (3, "d"), (5, "D"), (5, "e")]


@pytest.mark.parametrize("narrow", [-1, 1_000_000])
def test_exact_duplicates_by_value(spark, monkeypatch, narrow):
    monkeypatch.setattr(D, "NARROW_ROW_BYTES", narrow)
    rows = [(0, 0.0, "a", None), (1, -0.0, "a", None), (2, None, "a", "1"), (3, 1.0, None, "a"), (4, 1.0, "a", None), (5, float("nan"), "", ""), (6, float("nan"), "", "")]
    df = spark.createDataFrame(rows, "_row_id long, x double, s string, t string")
    assert ids(D.drop_exact_duplicates(df, "_row_id")) == [0, 2, 3, 4, 5]
    nested = df.selectExpr("_row_id", "array(s, t) AS a")
    assert ids(D.drop_exact_duplicates(nested, "_row_id")) == [0, 2, 3, 5]


def test_plan_by_width(spark, monkeypatch):
    """Narrow rows take one aggregate, wide ones digests; the rows are the same."""
    df = spark.createDataFrame([(i, "x" * (i % 3), i % 2) for i in range(60)] + [(None, "x", 1), (7, "x", 1)], "_row_id long, s string, k long")
    assert D.mean_width(df, [F.col("s"), F.col("k")]) < D.NARROW_ROW_BYTES
    monkeypatch.setattr(D, "NARROW_ROW_BYTES", -1)
    wide = sorted(map(str, D.drop_exact_duplicates(df, "_row_id").collect()))
    monkeypatch.setattr(D, "NARROW_ROW_BYTES", 1_000_000)
    narrow = D.drop_exact_duplicates(df, "_row_id")
    assert "Exchange" in narrow._jdf.queryExecution().executedPlan().toString() and sorted(map(str, narrow.collect())) == wide
    assert D.mean_width(df.limit(0), [F.col("s")]) == 0


def test_latch_with_null_payload(spark):
    entities = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    events = spark.createDataFrame([(1, None, 1), (2, "x", None), (2, "y", 5), (9, "z", 1)], "k long, v string, t long")
    got = {r.k: (r.first_v, r.latched) for r in V.latch(entities, events, "k", ["t"]).collect()}
    assert got == {1: (None, True), 2: ("y", True), 3: (None, False)}
