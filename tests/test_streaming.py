"""Stateful operators on streams against their batch forms and hand results."""

import random
from datetime import datetime, timedelta

import pytest

from mendframe.operators import events as V
from mendframe.streaming.arrivals import repair_arrivals
from mendframe.streaming.events import first_deliveries_stream, latest_latch
from mendframe.streaming.rate_limit import rate_limit_stream

T0 = datetime(2024, 1, 1)


def hits(spark, rows):
    return spark.createDataFrame(
        [(k, i, T0 + timedelta(seconds=s)) for i, (k, s) in enumerate(rows)], "k string, id long, ts timestamp")


def brute(rows, m, w):
    out, recent = {}, {}
    for i, (k, s) in sorted(enumerate(rows), key=lambda r: (r[1][1], r[0])):
        q = [t for t in recent.get(k, []) if s - t <= w]
        out[i] = len(q) < m
        recent[k] = q + [s] if out[i] else q
    return out


def test_rate_limit_fixture(spark):
    rows = [("a", s) for s in (0, 10, 20, 60, 61, 70, 71)]
    got = V.rate_limit(hits(spark, rows), "k", "ts", "id", max_hits=2, window_seconds=60)
    assert [r.accepted for r in got.orderBy("id").collect()] == [True, True, False, False, True, False, True]


@pytest.mark.parametrize("m,w", [(1, 5), (3, 60), (10, 7)])
def test_rate_limit_brute_force(spark, m, w):
    rng = random.Random(m)
    rows = [("hot" if rng.random() < 0.4 else rng.choice("abc"), rng.randrange(6000) * (1 if rng.random() < .8 else 40)) for _ in range(3000)]
    got = V.rate_limit(hits(spark, rows), "k", "ts", "id", max_hits=m, window_seconds=w)
    assert {r.id: r.accepted for r in got.collect()} == brute(rows, m, w)


def test_rate_limit_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted([(rng.choice("ab"), rng.randrange(900)) for _ in range(400)], key=lambda r: r[1])
    src = tmp_path / "src"
    for part in range(4):  # one micro-batch per file, in time order
        df = hits(spark, rows).filter(f"floor(id / 100) = {part}").coalesce(1)
        df.write.mode("append").parquet(str(src / f"p{part}"))
    stream = spark.readStream.schema("k string, id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    out = rate_limit_stream(stream, "k", "ts", "id", max_hits=3, window_seconds=60, lateness="2 hours")
    q = out.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.id: r.accepted for r in spark.table("limited").collect()}
    assert got == brute(rows, 3, 60)


def test_first_deliveries_stream(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([(i % 5, T0 + timedelta(seconds=i)) for i in range(20)], "id long, ts timestamp").write.parquet(src)
    stream = spark.readStream.schema("id long, ts timestamp").parquet(src)
    q = (first_deliveries_stream(stream, "id", "ts").writeStream.format("memory").queryName("firsts")
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r.id for r in spark.table("firsts").collect()) == [0, 1, 2, 3, 4]


def test_latest_latch(spark):
    batch = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k string, t int, v string")
    known = spark.createDataFrame([("b",)], "k string")
    assert [tuple(r) for r in latest_latch(batch, known, "k", ["t"]).select("k", "v").collect()] == [("a", "y")]


def test_arrivals(spark, tmp_path):
    src, out, cp = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    src.mkdir()
    (src / "a.csv").write_text("id,name\n1,a\n1,a\n2,b\n")
    repair_arrivals(spark, str(src), str(out), str(cp)).awaitTermination()
    (src / "b.csv").write_text("id,name\n7,z\n")
    repair_arrivals(spark, str(src), str(out), str(cp)).awaitTermination()
    repair_arrivals(spark, str(src), str(out), str(cp)).awaitTermination()
    rows = spark.read.parquet(str(out / "rows"))
    assert sorted(r.cells for r in rows.collect()) == [["1", "a"], ["2", "b"], ["7", "z"]]
    assert spark.read.parquet(str(out / "manifest")).count() == 2


def test_retention(spark):
    df = hits(spark, [("a", 0), ("a", 1800), ("a", 1801)])
    old = V.expired(df, "ts", "2024-01-01 01:00:01", 30)
    assert [r.id for r in old.orderBy("id").collect()] == [0, 1]
    assert V.retained(df, "ts", "2024-01-01 01:00:01", 30).count() == 1


def test_empty_arrivals_are_rejected_once(spark, tmp_path):
    src, out, cp = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    src.mkdir()
    (src / "none.csv").write_text("")
    repair_arrivals(spark, str(src), str(out), str(cp)).awaitTermination()
    (src / "a.csv").write_text("id,name\n1,a\n")
    repair_arrivals(spark, str(src), str(out), str(cp)).awaitTermination()
    got = spark.read.parquet(str(out / "rejected")).collect()
    assert [(r.name, r.reason) for r in got] == [("none.csv", "empty")]


def test_hits_without_key_or_time(spark):
    rows = [(1, None, 0), (2, None, 1), (3, None, 2), (4, "a", None), (5, "a", 0), (6, None, None), (7, "a", 500)]
    rows = [(i, k, None if s is None else T0 + timedelta(seconds=s)) for i, k, s in rows]
    got = V.rate_limit(spark.createDataFrame(rows, "id long, k string, ts timestamp"), "k", "ts", "id", max_hits=2, window_seconds=60)
    assert {r.id: r.accepted for r in got.collect()} == {1: True, 2: True, 3: False, 4: False, 5: True, 6: False, 7: True}


def test_admission_by_stretches():
    """Stretches give what one hit after the other gives."""
    import random
    from collections import deque

    import numpy as np

    draw = random.Random(9)
    for _ in range(300):
        m, w = draw.randrange(1, 5), draw.randrange(0, 9)
        times = np.array(sorted(draw.randrange(draw.choice([10, 60, 400])) for _ in range(draw.randrange(60))), dtype=np.int64)
        kept, want = [], []
        for t in times:
            kept = [x for x in kept if t - x <= w]
            want.append(len(kept) < m)
            if want[-1]:
                kept.append(t)
        cut = draw.randrange(len(times) + 1)
        recent = deque(maxlen=m)
        got = [*V.admit(times[:cut], recent, w, m), *V.admit(times[cut:], recent, w, m)]
        assert got == want


def test_latch_stream_first_wins_across_restarts(spark, tmp_path):
    """Late events of a latched key are ignored after a restart; a hot key's many rows reduce to its first."""
    from mendframe.streaming.events import latch_stream

    schema = "k long, note string, event_id long, ts timestamp"
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    first = [(1, "a", 10, "2024-01-02 00:00:00"), (1, "b", 11, "2024-01-01 00:00:00"), (2, None, 12, None), (2, "c", 13, None)]
    first += [(7, f"h{i}", 100 + i, f"2024-02-{i % 27 + 1:02d} 00:00:00") for i in range(3000)]   # one hot key
    late = [(1, "z", 1, "2023-01-01 00:00:00"), (3, "d", 14, "2024-01-05 00:00:00")]

    def run(rows, part):
        spark.createDataFrame(rows, "k long, note string, event_id long, ts string").selectExpr(
            "k", "note", "event_id", "CAST(ts AS timestamp) AS ts").write.mode("append").parquet(f"{src}/{part}")
        stream = spark.readStream.schema(schema).parquet(f"{src}/*")
        (latch_stream(stream, "k", ["ts", "event_id"]).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination())

    run(first, "p1")
    run(late, "p2")
    got = {r.k: (r.note, r.event_id) for r in spark.read.parquet(out).collect()}
    assert got == {1: ("b", 11), 2: (None, 12), 3: ("d", 14), 7: ("h0", 100)}
