"""Queries that go through files: tables are written damaged, then read and repaired."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files as S
from ..sources import sinks
from ..sources.workspace import Workspace, shared_dir
from . import inputs as I
from .clean_queries import RATE_LIMIT_SQL
from .registry import query, table
from .repair import repair


def _write_lines(df, path: str, header: str, line: str = "record", by: str | None = None) -> None:
    """Write a column as raw text lines, with a header line in every part file."""
    writer = df.withColumnRenamed(line, header).write.options(header=True, sep="\u0001", quote="", escape="\u0002")
    (writer.partitionBy(by) if by else writer).csv(path)


def _in_order(df: DataFrame, *order: str) -> DataFrame:
    """The rows in order as one partition, sorted by parallel tasks before.

    The sorted rows are checkpointed, so the task that writes them to one file
    passes them on one by one and holds none.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(f"{shared_dir(df.sparkSession)}/checkpoints")
    return df.orderBy(*order).drop(*order).checkpoint().coalesce(1)


OPEN_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


@contextmanager
def _open_writers(spark: SparkSession, most: int) -> Iterator[None]:
    """Tasks keep up to ``most`` partitions' files open, so that a partitioned write needs no sort (beyond that it sorts the rest)."""
    now = spark.conf.get(OPEN_WRITERS)
    spark.conf.set(OPEN_WRITERS, str(most))
    try:
        yield
    finally:
        spark.conf.set(OPEN_WRITERS, now)


@query("raw_segments", """WITH l AS (SELECT lang, string_split(text, chr(10)) AS p FROM documents)
SELECT lang, sum(len(p))::BIGINT AS n_lines, sum(list_sum(list_transform(p, lambda x: octet_length(encode(x)))))::BIGINT AS n_bytes FROM l GROUP BY lang""")
def raw_segments(spark, sf):
    """Documents written as text files and scanned back as raw segments."""
    ws = Workspace(spark)
    table(spark, sf, "documents").select("lang", F.col("text").alias("value")).write.partitionBy("lang").text(f"{ws.path}/texts")
    bronze = ws.save(S.read_segments(spark, [f"{ws.path}/texts"]), "bronze")
    lang = F.regexp_extract("file", "/lang=([^/]+)/", 1)
    return bronze.groupBy(lang.alias("lang")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.octet_length("raw")).cast("bigint").alias("n_bytes"))


@query("file_listing_facts", """SELECT o_orderstatus, 'utf-8' AS encoding, false AS has_cr, count(*) + 0 AS rows FROM orders GROUP BY o_orderstatus""")
def file_listing_facts(spark, sf):
    """Orders written as files per status; encoding and line facts by block, then by file."""
    ws = Workspace(spark)
    o = table(spark, sf, "orders").select("o_orderstatus", F.concat_ws(",", "o_orderkey", "o_custkey").alias("record"))
    o.write.partitionBy("o_orderstatus").text(f"{ws.path}/texts")
    bronze = ws.save(S.read_segments(spark, [f"{ws.path}/texts"]), "bronze")
    facts = S.file_facts(S.number_blocks(S.block_facts(bronze)))
    status = F.regexp_extract("file", "/o_orderstatus=([^/]+)/", 1)
    return facts.groupBy(status.alias("o_orderstatus"), "encoding", "has_cr").agg(F.sum("n_lines").cast("bigint").alias("rows"))


@query("delimited_round_trip", """SELECT p_partkey, p_name, p_brand, CASE p_partkey % 3 WHEN 0 THEN p_type || '; "' || p_brand || '"' ELSE p_type END AS p_type, p_size::BIGINT AS p_size FROM part""")
def delimited_round_trip(spark, sf):
    ws = Workspace(spark)
    kind = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_type", F.lit('; "'), "p_brand", F.lit('"'))).otherwise(F.col("p_type"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("_row_id"), "p_partkey", "p_name", "p_brand", kind.alias("p_type"), "p_size")
    sinks.write_delimited(p, f"{ws.path}/out", delimiter=";", order_by="_row_id")
    back = sinks.read_delimited(spark, f"{ws.path}/out", delimiter=";")
    return back.select(F.col("p_partkey").cast("bigint"), "p_name", "p_brand", "p_type", F.col("p_size").cast("bigint"))


@query("manifest_rows", """SELECT source AS job_id, CASE WHEN source <> 'src1' THEN count(*) END AS rows, 5::BIGINT AS cols, '' AS near_dupes_mode, ';' AS detected_delimiter,
  'original.csv' AS original_filename, false AS import_warning, 0 AS n_examples FROM documents GROUP BY source""")
def manifest_rows(spark, sf):
    """Counts as doubles, one of them not a number."""
    ws = Workspace(spark)
    n = F.when(F.col("source") == "src1", F.lit(float("nan"))).otherwise(F.count(F.lit(1)).cast("double"))
    runs = table(spark, sf, "documents").groupBy("source").agg(n.alias("rows")).withColumnRenamed("source", "job_id")
    m = sinks.manifest_rows(runs.withColumn("cols", F.lit(5)).withColumn("detected_delimiter", F.lit(";")))
    sinks.write_manifest(m, f"{ws.path}/manifest")
    return sinks.read_manifest(spark, f"{ws.path}/manifest").select(
        "job_id", "rows", "cols", "near_dupes_mode", "detected_delimiter", "original_filename", "import_warning",
        F.size("near_dupe_examples").alias("n_examples"))


_HEADER = "order_id,customer,status,priority"


def _repair_orders(spark, sf, **options):
    """Ragged order records in files of their priority, repaired."""
    ws = Workspace(spark)
    by = F.substring("o_orderpriority", 1, 1)
    records = I.order_records(spark, sf).join(table(spark, sf, "orders").select("o_orderkey", by.alias("level")), "o_orderkey")
    _write_lines(records.select("record", "level"), f"{ws.path}/texts", _HEADER, by="level")
    return repair(spark, [f"{ws.path}/texts"], **options)


_PARSED = f"""WITH {I.RECORDS}, f AS (SELECT o_orderkey, {I.sql_fields('record', "','")} AS f FROM records)"""


@query("repair_orders", f"""{_PARSED}
SELECT trim(coalesce(f[1], '')) AS order_id, trim(coalesce(f[2], '')) AS customer, trim(coalesce(f[3], '')) AS status,
  trim(coalesce(f[4], '')) AS priority, len(f) <> 4 AS repaired FROM f""")
def repair_orders(spark, sf):
    r = _repair_orders(spark, sf)
    cell = lambda i, name: F.get("cells", F.lit(i)).alias(name)
    return r.rows.select(cell(0, "order_id"), cell(1, "customer"), cell(2, "status"), cell(3, "priority"), F.col("_repaired").alias("repaired"))


@query("repair_report", f"""{_PARSED}
SELECT substring(o_orderpriority, 1, 1) AS level, ',' AS delimiter, 'order_id,customer,status,priority' AS header, count(*) AS rows,
  count(*) FILTER (len(f) > 4) AS too_long, count(*) FILTER (len(f) < 4) AS too_short, 0::BIGINT AS duplicate_rows,
  0::BIGINT AS empty_rows, count(*) AS rows_in, 'utf-8' AS encoding, false AS has_cr, false AS bom, true AS ends_nl
FROM f JOIN orders USING (o_orderkey) GROUP BY 1""")
def repair_report(spark, sf):
    r = _repair_orders(spark, sf)
    level = F.regexp_extract("file", "/level=([^/]+)/", 1)
    facts = ["encoding", "has_cr", "bom", "ends_nl"]
    return r.files.groupBy(level.alias("level"), "delimiter", F.array_join("header", ",").alias("header"), *facts).agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("rows", "too_long", "too_short", "duplicate_rows", "empty_rows", "rows_in")])


@query("repair_repairs", f"""{_PARSED} SELECT o_orderkey::VARCHAR AS order_id FROM f WHERE len(f) <> 4""")
def repair_repairs(spark, sf):
    """Orders whose row was cut or padded, found through the repaired-row table."""
    r = _repair_orders(spark, sf)
    hit = r.rows.join(r.repaired, ["file", "_row_id"], "left_semi")
    return hit.select(F.get("cells", F.lit(0)).alias("order_id"))


_ONE_FILE = f"""{_PARSED}, g AS (SELECT o_orderkey AS k, len(f) <> 4 AS repaired, trim(coalesce(f[1], '')) || '|' || trim(coalesce(f[2], '')) || '|' || trim(coalesce(f[3], ''))
  || '|' || trim(coalesce(f[4], '')) AS line FROM f)"""


@query("result_view", f"""{_ONE_FILE}
SELECT 'first' AS part, line FROM (SELECT line FROM g ORDER BY k LIMIT 10) UNION ALL SELECT 'last', line FROM (SELECT line FROM g ORDER BY k DESC LIMIT 10)
UNION ALL SELECT 'repaired', line FROM (SELECT line FROM g WHERE repaired ORDER BY k LIMIT 10)
UNION ALL SELECT 'summary', count(*) || '|4|true|' || count(*) FILTER (repaired) || '|UTF-8|Unchanged|First row|,' FROM g""")
def result_view(spark, sf):
    """All orders as one file in key order: its summary and its previews."""
    ws = Workspace(spark)
    _write_lines(_in_order(I.order_records(spark, sf), "o_orderkey"), f"{ws.path}/texts", _HEADER)
    r = repair(spark, [f"{ws.path}/texts"])
    v = r.view(r.files.select("file").first()["file"])
    rows = [d.select(F.lit(part).alias("part"), F.concat_ws("|", "order_id", "customer", "status", "priority").alias("line"))
            for part, d in (("first", v.first), ("last", v.last), ("repaired", v.repaired))]
    summary = v.summary.select(F.lit("summary").alias("part"), F.concat_ws(
        "|", "rows", "cols", "import_warning", "repaired_rows", "encoding_label", "numbers_label", "header_label", "detected_delimiter").alias("line"))
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(summary)


@query("repair_near_duplicates", """SELECT c_nationkey % 3 AS part, c_nationkey::VARCHAR AS nation, min(c_custkey) AS first_cust, upper(c_mktsegment) AS segment,
  count(*) OVER (PARTITION BY c_nationkey % 3) AS kept_in_file FROM customer GROUP BY c_nationkey, upper(c_mktsegment)""")
def repair_near_duplicates(spark, sf):
    """Customers in three files, near-duplicates removed across case and blanks.

    The id column is ignored when rows are compared; the first row of each
    group in its file stays.
    """
    ws = Workspace(spark)
    seg = F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    line = F.concat_ws(";", "c_custkey", F.concat(F.lit(" "), seg, F.lit(" ")), "c_nationkey")
    c = table(spark, sf, "customer").select(line.alias("record"), (F.col("c_nationkey") % 3).alias("part"), "c_custkey")
    with _open_writers(spark, 8):
        _write_lines(_in_order(c, "c_custkey"), f"{ws.path}/texts", "cust_id;market_segment;nation_key", by="part")
    r = repair(spark, [f"{ws.path}/texts"], near_dupes="remove")
    cell = lambda i: F.get("cells", F.lit(i))
    part = F.regexp_extract("file", "/part=([^/]+)/", 1).cast("int")
    rows = r.rows.select(part.alias("part"), cell(2).alias("nation"), F.upper(cell(1)).alias("segment"), cell(0).cast("bigint").alias("first_cust"))
    counts = r.files.select(part.alias("part"), F.col("rows").alias("kept_in_file"))
    return rows.join(counts, "part")


@query("repair_numbers", f"""WITH {I.AMOUNTS} SELECT o_orderkey AS order_key, round({I.sql_number('eu')}, 6) AS eu_price, round({I.sql_number('us')}, 6) AS us_price FROM amounts""")
def repair_numbers(spark, sf):
    """Localized prices through files, converted to doubles by the repair."""
    ws = Workspace(spark)
    line = F.concat_ws("|", F.concat(F.lit("k"), "o_orderkey"), "eu", "us")
    _write_lines(I.localized_amounts(spark, sf).select(line.alias("record")), f"{ws.path}/texts", "order_key|eu_price|us_price")
    r = repair(spark, [f"{ws.path}/texts"], normalize_numbers=True)
    cell = lambda i: F.get("cells", F.lit(i))
    return r.rows.select(F.substring(cell(0), 2, 20).cast("bigint").alias("order_key"),
                         F.round(cell(1).cast("double"), 6).alias("eu_price"), F.round(cell(2).cast("double"), 6).alias("us_price"))


@query("changelog_rows", f"""{_PARSED}, c AS (SELECT count(*) FILTER (len(f) > 4) AS l, count(*) FILTER (len(f) < 4) AS s FROM f)
SELECT 'repair' AS class, 'Fixed ' || l || ' rows with extra columns (import repair).' AS message FROM c
UNION ALL SELECT 'repair', 'Fixed ' || s || ' rows with missing columns (import repair).' FROM c
UNION ALL SELECT 'check', unnest(['Detected encoding: utf-8.', 'Header appears to be on the first line (no preamble removed).',
  'No exact duplicate rows found.', 'No fully empty rows found.', 'No whitespace issues found in text cells.'])""")
def changelog_rows(spark, sf):
    """Messages of a repair run; counts per file are summed over the files."""
    r = _repair_orders(spark, sf)
    rows = r.changelog()
    fixed = r"^Fixed ([\d,]+) rows with (extra|missing) columns \(import repair\)\.$"
    n = F.regexp_replace(F.regexp_extract("message", fixed, 1), ",", "")
    summed = rows.filter(F.col("message").rlike(fixed)).groupBy("class", F.regexp_extract("message", fixed, 2).alias("kind")).agg(
        F.sum(n.cast("bigint")).alias("n")).select("class", F.concat(
            F.lit("Fixed "), F.col("n").cast("string"), F.lit(" rows with "), "kind", F.lit(" columns (import repair).")).alias("message"))
    shown = ["Detected encoding: utf-8.", "Header appears to be on the first line (no preamble removed).", "No exact duplicate rows found.",
             "No fully empty rows found.", "No whitespace issues found in text cells."]
    return summed.unionByName(rows.filter(F.col("message").isin(shown)).select("class", "message").distinct())


# --- streams over the events table ---------------------------------------------

def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def _drain(df, ws, name):
    """Run a stream over all available input into a table."""
    (df.writeStream.format("parquet").option("path", f"{ws.path}/{name}").option("checkpointLocation", f"{ws.path}/{name}-cp")
        .trigger(availableNow=True).start().awaitTermination())
    return df.sparkSession.read.schema(df.schema).parquet(f"{ws.path}/{name}")


@query("rate_limit_stream", RATE_LIMIT_SQL.format(w=86_400_000_000, m=2))
def rate_limit_stream(spark, sf):
    from ..streaming.rate_limit import rate_limit_stream as limit

    out = limit(_event_stream(spark, sf), "user_id", "ts", "event_id", max_hits=2, window_seconds=86_400, lateness="30 days")
    return _drain(out, Workspace(spark), "limited").select("id", "accepted")


@query("first_deliveries_stream", """SELECT event_id // 3 AS delivery_id, count(*) > 0 AS is_delivered, 1::BIGINT AS n FROM events GROUP BY 1""")
def first_deliveries_stream(spark, sf):
    from ..streaming.events import first_deliveries_stream as first

    e = _event_stream(spark, sf).select(F.floor(F.col("event_id") / 3).alias("delivery_id"), "event_id", "ts")
    kept = _drain(first(e, "delivery_id", "ts", "30 days"), Workspace(spark), "firsts")
    # any delivery of an id may be the one that arrives first; it must be one of the id's own, and the only one
    own = table(spark, sf, "events").select(F.floor(F.col("event_id") / 3).alias("delivery_id"), "event_id")
    return kept.join(own, ["delivery_id", "event_id"], "left").groupBy("delivery_id").agg(
        F.bool_and(F.col("event_id").isNotNull()).alias("is_delivered"), F.count(F.lit(1)).alias("n"))


@query("status_latch_stream", """WITH p AS (SELECT user_id AS c_custkey, CASE WHEN event_id % 3 <> 0 THEN event_type END AS note, event_id, CASE WHEN event_id % 7 <> 0 THEN ts END AS ts
  FROM events WHERE event_type = 'purchase'),
q AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY ts NULLS LAST, event_id) AS rn FROM p)
SELECT c.c_custkey, c.c_name, q.note AS first_note, q.event_id AS first_event_id, q.event_id IS NOT NULL AS latched
FROM customer c LEFT JOIN q ON q.c_custkey = c.c_custkey AND q.rn = 1""")
def status_latch_stream(spark, sf):
    """The latch of ``status_latch`` as a stream: first-wins state per customer, drained, joined to all customers."""
    from ..streaming.events import latch_stream

    e = _event_stream(spark, sf).filter("event_type = 'purchase'").select(
        F.col("user_id").alias("c_custkey"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("note"), "event_id",
        F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("ts"))
    first = _drain(latch_stream(e, "c_custkey", ["ts", "event_id"]), Workspace(spark), "latched")
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    flat = first.select("c_custkey", F.col("note").alias("first_note"), F.col("event_id").alias("first_event_id"), F.lit(True).alias("_l"))
    return c.join(flat, "c_custkey", "left").select("c_custkey", "c_name", "first_note", "first_event_id",
                                                    F.coalesce("_l", F.lit(False)).alias("latched"))


@query("file_arrivals", """SELECT o_orderkey::VARCHAR AS order_id, o_custkey::VARCHAR AS customer FROM orders""")
def file_arrivals(spark, sf):
    from ..streaming.arrivals import repair_arrivals

    ws = Workspace(spark)
    o = table(spark, sf, "orders").select(F.concat_ws(",", "o_orderkey", "o_custkey").alias("record"))
    _write_lines(o, f"{ws.path}/in", "order_id,customer")
    repair_arrivals(spark, f"{ws.path}/in/*.csv", f"{ws.path}/out", f"{ws.path}/cp").awaitTermination()
    rows = spark.read.parquet(f"{ws.path}/out/rows")
    return rows.select(F.get("cells", F.lit(0)).alias("order_id"), F.get("cells", F.lit(1)).alias("customer"))


@query("file_arrivals_rejected", """SELECT 'empty.csv' AS name, 'empty' AS reason, 1::BIGINT AS n FROM (SELECT count(*) FROM orders)
UNION ALL SELECT o_orderstatus || '.bin', 'extension', 1 FROM orders GROUP BY o_orderstatus""")
def file_arrivals_rejected(spark, sf):
    """Orders by status in files of a refused kind, next to a file without content; rejected once in two runs."""
    from ..streaming.arrivals import repair_arrivals

    ws = Workspace(spark)
    o = table(spark, sf, "orders").select(F.concat_ws(",", "o_orderkey", "o_custkey").alias("value"), "o_orderstatus")
    with _open_writers(spark, 8):  # the scan and its rows stay parallel up to the task that writes
        o.repartition(1).write.partitionBy("o_orderstatus").text(f"{ws.path}/made")
    fs, path = ws._fs, ws.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(path(f"{ws.path}/in"))
    fs.create(path(f"{ws.path}/in/empty.csv")).close()
    for r in spark.read.format("binaryFile").load(f"{ws.path}/made").select("path").collect():  # one for each status
        status = r["path"].split("o_orderstatus=")[1].split("/")[0]
        fs.rename(path(r["path"]), path(f"{ws.path}/in/{status}.bin"))
    for _ in range(2):
        repair_arrivals(spark, f"{ws.path}/in", f"{ws.path}/out", f"{ws.path}/cp").awaitTermination()
    got = spark.read.parquet(f"{ws.path}/out/rejected")
    return got.groupBy("name", "reason").agg(F.count(F.lit(1)).alias("n"))
