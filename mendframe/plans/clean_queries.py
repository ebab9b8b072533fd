"""Queries over tables: names, whitespace, numbers, duplicates, events, previews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import names as N
from ..functions.compare import compare_text
from ..functions.numbers import parse_number
from ..operators import clean as C
from ..operators import dedup as D
from ..operators import events as V
from ..operators import numeric as NUM
from ..operators import parse as P
from ..operators import preview as R
from . import inputs as I
from .registry import query, table

# --- names ---------------------------------------------------------------------

_NAMES = r"""n AS (SELECT doc_id, list_transform(string_split(regexp_replace(text, '[.,]+', '.', 'g'), '.'),
  lambda w: coalesce(nullif(trim(regexp_replace(regexp_replace(lower(trim(w, ' ' || chr(10) || chr(9))), '[^\p{L}\p{N}_\s]', '', 'g'), '[\s_]+', '_', 'g'), '_'), ''), 'col')) AS names FROM documents)"""


def _phrases(spark, sf):
    """Every document's clauses as an array of raw column names."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.split(F.regexp_replace("text", "[.,]+", "."), r"\.").alias("raw"))


@query("snake_names", f"""WITH {_NAMES}
SELECT doc_id, array_to_string(names, '|') AS names FROM n""")
def snake_names(spark, sf):
    return _phrases(spark, sf).select("doc_id", F.array_join(N.snake_names(F.col("raw")), "|").alias("names"))


_HEADERS = """h AS (SELECT c_custkey, [lower(c_mktsegment), 'id', 'seg' || (c_custkey % 3), 'id', lower(c_mktsegment), 'id_2', 'seg' || (c_nationkey % 3),
  'seg0', 'seg0', 'seg0_2'] AS names FROM customer)"""


def _headers(spark, sf):
    seg = F.lower("c_mktsegment")
    n = [seg, F.lit("id"), F.concat(F.lit("seg"), (F.col("c_custkey") % 3).cast("string")), F.lit("id"), seg, F.lit("id_2"),
         F.concat(F.lit("seg"), (F.col("c_nationkey") % 3).cast("string")), F.lit("seg0"), F.lit("seg0"), F.lit("seg0_2")]
    return table(spark, sf, "customer").select("c_custkey", F.array(*n).alias("names"))


@query("unique_names", f"""WITH RECURSIVE {_HEADERS},
u(c_custkey, names, i, done) AS (
  SELECT c_custkey, names, 1, []::VARCHAR[] FROM h
  UNION ALL
  SELECT c_custkey, names, i + 1, list_append(done, CASE WHEN NOT list_contains(done, names[i]) THEN names[i]
    ELSE list_filter(list_transform(range(2, 13), lambda k: names[i] || '_' || k), lambda t: NOT list_contains(done, t))[1] END)
  FROM u WHERE i <= len(names))
SELECT c_custkey, array_to_string(done, '|') AS names FROM u WHERE i > len(names)""")
def unique_names(spark, sf):
    return _headers(spark, sf).select("c_custkey", F.array_join(N.unique_names("names"), "|").alias("names"))


@query("ignorable_names", """WITH n AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN event_type || '_id' WHEN 1 THEN ' ID ' WHEN 2 THEN 'id_' || event_type
    WHEN 3 THEN event_type || '_at' WHEN 4 THEN 'ref_' || event_type WHEN 5 THEN event_type WHEN 6 THEN event_type || '_date' WHEN 7 THEN 'remaining_' || event_type
    ELSE 'v' || user_id END AS name FROM events)
SELECT event_id, name, regexp_matches(trim(lower(name)), '^id$|_id$|^id_|_id_|uuid|guid|transaction|txn|reference|^ref$|ref_|_ref$|date|time|_at$|balance|running_total|remaining') AS ignored FROM n""")
def ignorable_names(spark, sf):
    m, t = F.col("event_id") % 9, F.col("event_type")
    name = (
        F.when(m == 0, F.concat(t, F.lit("_id"))).when(m == 1, F.lit(" ID ")).when(m == 2, F.concat(F.lit("id_"), t))
        .when(m == 3, F.concat(t, F.lit("_at"))).when(m == 4, F.concat(F.lit("ref_"), t)).when(m == 5, t)
        .when(m == 6, F.concat(t, F.lit("_date"))).when(m == 7, F.concat(F.lit("remaining_"), t))
        .otherwise(F.concat(F.lit("v"), F.col("user_id").cast("string")))
    )
    e = table(spark, sf, "events").select("event_id", name.alias("name"))
    return e.select("event_id", "name", N.is_ignorable_name("name").alias("ignored"))


# --- whitespace, empty rows, standard pass ---------------------------------------

def _parts(spark, sf):
    return C.normalize_names(I.messy_parts(spark, sf), "p_partkey")


@query("trim_cells", f"""WITH {I.PARTS} SELECT * FROM trimmed""")
def trim_cells(spark, sf):
    return C.trim_cells(_parts(spark, sf), "p_partkey")


@query("trim_counts", f"""WITH {I.PARTS}
SELECT 'part_name' AS "column", count(*) FILTER (name <> trim(name, ' ' || chr(9))) AS changed FROM parts0
UNION ALL SELECT 'parttype_x', count(*) FILTER (kind <> trim(kind, ' ' || chr(9))) FROM parts0
UNION ALL SELECT 'updated_at', count(*) FILTER (updated <> trim(updated, ' ' || chr(9))) FROM parts0
UNION ALL SELECT 'parttype_x_2', count(*) FILTER (kind <> trim(kind, ' ' || chr(9))) FROM parts0""")
def trim_counts(spark, sf):
    return C.count_trimmed(_parts(spark, sf), "p_partkey")


@query("empty_rows_removed", f"""WITH {I.PARTS}
SELECT p_partkey, name AS part_name, kind AS parttype_x, updated AS updated_at, kind AS parttype_x_2 FROM parts0
WHERE NOT (trim(name, ' ' || chr(9)) = '' AND trim(kind, ' ' || chr(9)) = '' AND updated = '')""")
def empty_rows_removed(spark, sf):
    return C.drop_empty_rows(_parts(spark, sf), "p_partkey")


@query("clean_table", f"""WITH {I.PARTS},
k AS (SELECT *, row_number() OVER (PARTITION BY part_name, parttype_x, updated_at, parttype_x_2 ORDER BY p_partkey) AS rn FROM trimmed
  WHERE NOT (part_name = '' AND parttype_x = '' AND updated_at = ''))
SELECT p_partkey, part_name, parttype_x, updated_at, parttype_x_2 FROM k WHERE rn = 1""")
def clean_table(spark, sf):
    return C.clean_table(I.messy_parts(spark, sf), "p_partkey")


@query("table_shape", """SELECT count(*) AS rows, 10::BIGINT AS cols FROM lineitem""")
def table_shape(spark, sf):
    return C.shape(table(spark, sf, "lineitem"), "l_orderkey")


# --- numbers ------------------------------------------------------------------------

@query("parse_numbers", f"""WITH {I.AMOUNTS}
SELECT o_orderkey, round({I.sql_number('eu')}, 6) AS eu_value, round({I.sql_number('us')}, 6) AS us_value,
  round({I.sql_number('mixed')}, 6) AS mixed_value, {I.sql_number('code')} AS code_value, {I.sql_number('note')} AS note_value FROM amounts""")
def parse_numbers(spark, sf):
    a = I.localized_amounts(spark, sf)
    return a.select("o_orderkey", *[F.round(parse_number(c), 6).alias(f"{c}_value") for c in ("eu", "us", "mixed")],
                    parse_number("code").alias("code_value"), parse_number("note").alias("note_value"))


_ELIGIBLE = f"""WITH {I.AMOUNTS},
v AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, {c} AS cell, {I.sql_number(c)} AS value FROM amounts" for c in ('eu', 'us', 'mixed', 'code', 'note'))}),
e AS (SELECT col, count(*) FILTER (trim(cell) <> '') AS n, count(value) AS ok FROM v GROUP BY col)"""


@query("numeric_eligibility", f"""{_ELIGIBLE}
SELECT col AS "column", n, ok, round(ok / n, 6) AS rate, n >= 5 AND ok / n >= 0.85 AS eligible FROM e""")
def numeric_eligibility(spark, sf):
    return NUM.numeric_eligibility(I.localized_amounts(spark, sf), "o_orderkey").withColumn("rate", F.round("rate", 6))


@query("normalize_numbers", f"""WITH {I.AMOUNTS}
SELECT o_orderkey, round({I.sql_number('eu')}, 6) AS eu, round({I.sql_number('us')}, 6) AS us, round({I.sql_number('mixed')}, 6) AS mixed, code, note FROM amounts""")
def normalize_numbers(spark, sf):
    n = NUM.normalize_numbers(I.localized_amounts(spark, sf), "o_orderkey")
    return n.select([F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in n.dtypes])


# --- duplicates -------------------------------------------------------------------------

@query("exact_dedup_documents", """SELECT doc_id, text, lang, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY text, lang, source, n_chars ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def exact_dedup_documents(spark, sf):
    return D.drop_exact_duplicates(table(spark, sf, "documents"), "doc_id")


# Copies with folded case and padded blanks; ``batch_id`` and ``created_at`` are ignored.
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_COPIES = f"""c AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN translate(text, '{_LOWER}', '{_UPPER}') WHEN 1 THEN '  ' || replace(text, ' ', '  ') ELSE text END AS body,
  lang, doc_id % 7 AS batch_id, '2024-01-0' || (doc_id % 9 + 1) AS created_at FROM documents)"""


def _copies(spark, sf):
    m = F.col("doc_id") % 3
    body = (F.when(m == 0, F.translate("text", _LOWER, _UPPER)).when(m == 1, F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("  "))))
            .otherwise(F.col("text")))
    return table(spark, sf, "documents").select(
        "doc_id", body.alias("body"), "lang", (F.col("doc_id") % 7).alias("batch_id"),
        F.concat(F.lit("2024-01-0"), (F.col("doc_id") % 9 + 1).cast("string")).alias("created_at"))


_MASK = f"""WITH {_COPIES}, k AS (SELECT *, {I.FOLD.format('body')} AS kb, {I.FOLD.format('lang')} AS kl FROM c),
m AS (SELECT *, row_number() OVER (PARTITION BY kb, kl ORDER BY doc_id) AS rn,
  first_value(doc_id) OVER (PARTITION BY kb, kl ORDER BY doc_id) AS kept_id, count(*) OVER (PARTITION BY kb, kl) AS n FROM k)"""


@query("compare_keys", f"""WITH {_COPIES} SELECT doc_id, {I.FOLD.format('body')} AS key FROM c""")
def compare_keys(spark, sf):
    return _copies(spark, sf).select("doc_id", compare_text("body").alias("key"))


@query("near_dup_mask_documents", f"""{_MASK} SELECT doc_id, rn > 1 AS is_near_dup FROM m""")
def near_dup_mask_documents(spark, sf):
    return D.mark_near_duplicates(_copies(spark, sf), "doc_id").select("doc_id", "is_near_dup")


@query("near_dup_count", f"""{_MASK} SELECT count(*) FILTER (rn > 1) AS near_dupes FROM m""")
def near_dup_count(spark, sf):
    return D.count_near_duplicates(_copies(spark, sf), "doc_id")


@query("near_dups_removed_documents", f"""{_MASK} SELECT doc_id, body, lang, batch_id, created_at FROM m WHERE rn = 1""")
def near_dups_removed_documents(spark, sf):
    return D.drop_near_duplicates(_copies(spark, sf), "doc_id")


_PAIRS = f"""{_MASK}, p AS (SELECT kept_id, doc_id FROM m WHERE rn > 1 ORDER BY kept_id, doc_id LIMIT 5)"""


@query("near_dup_examples", f"""{_PAIRS} SELECT p.kept_id, a.body AS kept_body, a.created_at AS kept_created_at,
  p.doc_id AS removed_id, b.body AS removed_body, b.created_at AS removed_created_at
FROM p JOIN c a ON a.doc_id = p.kept_id JOIN c b ON b.doc_id = p.doc_id""")
def near_dup_examples(spark, sf):
    ex = D.near_duplicate_examples(_copies(spark, sf), "doc_id")
    return ex.select(
        F.col("kept.doc_id").alias("kept_id"), F.col("kept.body").alias("kept_body"), F.col("kept.created_at").alias("kept_created_at"),
        F.col("removed.doc_id").alias("removed_id"), F.col("removed.body").alias("removed_body"),
        F.col("removed.created_at").alias("removed_created_at"))


@query("near_dup_comparison", f"""{_PAIRS}, q AS (SELECT *, row_number() OVER (ORDER BY kept_id, doc_id) AS example FROM p)
SELECT example, 'Kept' AS status, c.* FROM q JOIN c ON c.doc_id = q.kept_id
UNION ALL SELECT example, 'Would remove', c.* FROM q JOIN c ON c.doc_id = q.doc_id""")
def near_dup_comparison(spark, sf):
    return D.comparison_rows(D.near_duplicate_examples(_copies(spark, sf), "doc_id"), mode="preview")


@query("near_dup_groups", f"""{_MASK} SELECT kept_id, doc_id AS row_id, n FROM m""")
def near_dup_groups(spark, sf):
    return D.group_occurrences(_copies(spark, sf), "doc_id")


@query("near_dup_mask_customers", """WITH k AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey, lower(c_mktsegment) ORDER BY c_custkey) AS rn FROM customer)
SELECT c_custkey, rn > 1 AS is_near_dup FROM k""")
def near_dup_mask_customers(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return D.mark_near_duplicates(c, "c_custkey").select("c_custkey", "is_near_dup")


@query("exact_dedup_lineitem_terms", """SELECT min(l_orderkey * 10 + l_linenumber) AS line_id, l_returnflag, l_linestatus, l_discount, l_tax, l_quantity
FROM lineitem GROUP BY ALL""")
def exact_dedup_lineitem_terms(spark, sf):
    li = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"),
        "l_returnflag", "l_linestatus", "l_discount", "l_tax", "l_quantity")
    return D.drop_exact_duplicates(li, "line_id")


# --- keyed, time-ordered ----------------------------------------------------------------

# Hits of each key in order; the list holds the accepted times still remembered.
RATE_LIMIT_SQL = """WITH RECURSIVE h AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f(user_id, i, event_id, ok, q) AS (
  SELECT user_id, i, event_id, true, [us] FROM h WHERE i = 1
  UNION ALL
  SELECT h.user_id, h.i, h.event_id, len(list_filter(f.q, lambda t: h.us - t <= {w})) < {m},
    CASE WHEN len(list_filter(f.q, lambda t: h.us - t <= {w})) < {m} THEN list_append(list_filter(f.q, lambda t: h.us - t <= {w}), h.us)
      ELSE list_filter(f.q, lambda t: h.us - t <= {w}) END
  FROM f JOIN h ON h.user_id = f.user_id AND h.i = f.i + 1)
SELECT event_id AS id, ok AS accepted FROM f"""


@query("rate_limit_events", RATE_LIMIT_SQL.format(w=86_400_000_000, m=2))
def rate_limit_events(spark, sf):
    return V.rate_limit(table(spark, sf, "events"), "user_id", "ts", "event_id", max_hits=2, window_seconds=86_400)


@query("rate_limit_hourly", RATE_LIMIT_SQL.format(w=3_600_000_000, m=1))
def rate_limit_hourly(spark, sf):
    return V.rate_limit(table(spark, sf, "events"), "user_id", "ts", "event_id", max_hits=1, window_seconds=3_600)


_ODD_HITS = """e AS (SELECT event_id, CASE user_id % 10 WHEN 0 THEN -1 WHEN 1 THEN -2 ELSE user_id END AS user_id,
  CASE WHEN event_id % 50 <> 7 THEN ts END AS ts FROM events), """


@query("rate_limit_odd_hits", RATE_LIMIT_SQL.format(w=3_600_000_000, m=3).replace("FROM events)", "FROM e WHERE ts IS NOT NULL)").replace("WITH RECURSIVE ", "WITH RECURSIVE " + _ODD_HITS)
       + " UNION ALL SELECT event_id, false FROM e WHERE ts IS NULL")
def rate_limit_odd_hits(spark, sf):
    """A tenth of the users as one busy key, a tenth without a key, some hits without a time."""
    u = F.col("user_id") % 10
    e = table(spark, sf, "events").select(
        "event_id", F.when(u == 0, -1).when(u != 1, F.col("user_id")).alias("user_id"), F.when(F.col("event_id") % 50 != 7, F.col("ts")).alias("ts"))
    return V.rate_limit(e, "user_id", "ts", "event_id", max_hits=3, window_seconds=3_600)


@query("expired_events", """SELECT event_id, user_id FROM events WHERE ts < TIMESTAMP '2024-01-02 12:00:00' - INTERVAL 30 MINUTE""")
def expired_events(spark, sf):
    return V.expired(table(spark, sf, "events"), "ts", "2024-01-02 12:00:00").select("event_id", "user_id")


_DELIVERIES = """d AS (SELECT event_id // 3 AS delivery_id, event_id, user_id, event_type, ts FROM events)"""


def _deliveries(spark, sf):
    return table(spark, sf, "events").select(F.floor(F.col("event_id") / 3).alias("delivery_id"), "event_id", "user_id", "event_type", "ts")


@query("first_deliveries", f"""WITH {_DELIVERIES}
SELECT delivery_id, event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY delivery_id ORDER BY ts, event_id) AS rn FROM d) WHERE rn = 1""")
def first_deliveries(spark, sf):
    return V.first_events(_deliveries(spark, sf), "delivery_id", ["ts", "event_id"]).select("delivery_id", "event_id", "user_id", "event_type")


@query("status_latch", """WITH p AS (SELECT user_id AS c_custkey, CASE WHEN event_id % 3 <> 0 THEN event_type END AS note, event_id, CASE WHEN event_id % 7 <> 0 THEN ts END AS ts
  FROM events WHERE event_type = 'purchase'),
q AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY ts NULLS LAST, event_id) AS rn FROM p)
SELECT c.c_custkey, c.c_name, q.note AS first_note, q.event_id AS first_event_id, q.event_id IS NOT NULL AS latched
FROM customer c LEFT JOIN q ON q.c_custkey = c.c_custkey AND q.rn = 1""")
def status_latch(spark, sf):
    """The first payload column may be null, and events may have no time."""
    e = table(spark, sf, "events").filter("event_type = 'purchase'").select(
        F.col("user_id").alias("c_custkey"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("note"), "event_id",
        F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("ts"))
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    return V.latch(c, e, "c_custkey", ["ts", "event_id"]).drop("first_ts")


# --- previews -----------------------------------------------------------------------------

@query("head_rows", """SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 10""")
def head_rows(spark, sf):
    return R.head(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")


@query("tail_rows", """SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey DESC LIMIT 10""")
def tail_rows(spark, sf):
    return R.tail(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")


@query("repaired_preview", f"""WITH {I.RECORDS}, f AS (SELECT o_orderkey, record, len({I.sql_fields('record', "','")}) AS n FROM records)
SELECT o_orderkey, record FROM f WHERE n <> 4 ORDER BY o_orderkey LIMIT 10""")
def repaired_preview(spark, sf):
    rows = P.with_conformed(I.order_records(spark, sf), F.col("record"), ",", 4)
    return R.repaired_rows(rows, "o_orderkey").select("o_orderkey", "record")


@query("result_badges", """WITH m AS (SELECT source, list(CASE doc_id % 5 WHEN 0 THEN 'Normalized numeric formats in 2 column(s)' ELSE 'No change in ' || lang END) AS log FROM documents GROUP BY source)
SELECT source, 'UTF-8' AS encoding_label, CASE WHEN len(list_filter(log, lambda x: contains(x, 'Normalized numeric formats'))) > 0 THEN 'Normalized' ELSE 'Unchanged' END AS numbers_label,
  CASE WHEN len(list_filter(log, lambda x: contains(x, 'Header detected'))) > 0 THEN 'Auto-detected' ELSE 'First row' END AS header_label FROM m""")
def result_badges(spark, sf):
    message = F.when(F.col("doc_id") % 5 == 0, F.lit("Normalized numeric formats in 2 column(s)")).otherwise(F.concat(F.lit("No change in "), "lang"))
    # A run's changelog is a short list of distinct messages.
    log = table(spark, sf, "documents").groupBy("source").agg(F.collect_set(message).alias("changelog"))
    return log.select("source", L.badges("changelog").alias("b")).select("source", "b.*")
