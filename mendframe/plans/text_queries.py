"""Queries over texts: admission, encoding, lines, records, fields, rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as X
from ..operators import parse as P
from . import inputs as I
from .registry import query, table


def _parity_sql(source: str, key: str) -> str:
    """Quote-parity records by running sums over the lines of each text."""
    return f"""
p AS (SELECT {key}, string_split(text, chr(10)) AS p FROM {source}),
l AS (SELECT {key}, unnest(p) AS line, generate_subscripts(p, 1) AS ln FROM p),
q AS (SELECT *, coalesce(sum(len(line) - len(replace(line, '"', ''))) OVER (
        PARTITION BY {key} ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 AS open_before FROM l),
r AS (SELECT *, sum(CASE WHEN open_before = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY ln) AS rec FROM q),
g AS (SELECT {key}, rec, count(*) AS n_phys, string_agg(line, chr(10) ORDER BY ln) AS record FROM r GROUP BY ALL)"""


@query("text_lines", f"""WITH {I.FILES}, {I.LINES}
SELECT doc_id, ln::BIGINT AS ln, line FROM lines""")
def text_lines(spark, sf):
    d = I.file_texts(spark, sf)
    return d.select("doc_id", F.posexplode(X.lines("text")).alias("ln", "line")).withColumn("ln", F.col("ln").cast("bigint"))


@query("stitch_records", f"""WITH {I.FILES}, {_parity_sql('files', 'doc_id')}
SELECT doc_id, rec::BIGINT AS rec, n_phys, record FROM g""")
def stitch_records(spark, sf):
    d = I.file_texts(spark, sf)
    recs = d.select("doc_id", F.posexplode(X.parity_records("text")).alias("pos", "record"))
    return recs.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("rec"),
                       (X.count_char("record", "\n") + 1).cast("bigint").alias("n_phys"), "record")


@query("stitch_stats", f"""WITH {I.FILES}, {_parity_sql('files', 'doc_id')}
SELECT doc_id, sum(n_phys)::BIGINT AS physical_lines, count(*) AS logical_lines,
  count(*) FILTER (n_phys > 1) AS stitched_records, greatest(1, max(n_phys)) AS max_physical_per_record
FROM g GROUP BY doc_id""")
def stitch_stats(spark, sf):
    return I.file_texts(spark, sf).select("doc_id", X.stitch_stats("text").alias("s")).select("doc_id", "s.*")


@query("stitch_stats_pages", f"""WITH src AS (SELECT page_id, html AS text FROM pages), {_parity_sql('src', 'page_id')}
SELECT page_id, sum(n_phys)::BIGINT AS physical_lines, count(*) AS logical_lines,
  count(*) FILTER (n_phys > 1) AS stitched_records, greatest(1, max(n_phys)) AS max_physical_per_record
FROM g GROUP BY page_id""")
def stitch_stats_pages(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", X.stitch_stats("html").alias("s")).select("page_id", "s.*")


# Record boundaries of the lenient parser: each line is a function of the
# open/closed state, and the state before a line is the last constant line
# flipped by the swaps since.  A final newline inside an open field stays in it.
_CSV_RECORDS = f"""
d AS (SELECT doc_id, ln, line, CASE doc_id % 6 WHEN 2 THEN ';' WHEN 3 THEN chr(9) WHEN 4 THEN '|' ELSE ',' END AS d FROM lines),
e AS (SELECT *, regexp_matches({I.sql_raw_fields('line', 'd')}[-1], '\\A"[^"]*(?:""[^"]*)*\\z') AS c,
        regexp_matches({I.sql_raw_fields("('\"' || line)", 'd')}[-1], '\\A"[^"]*(?:""[^"]*)*\\z') AS o FROM d),
s AS (SELECT *, sum(CASE WHEN c AND NOT o THEN 1 ELSE 0 END) OVER w AS swaps FROM e
      WINDOW w AS (PARTITION BY doc_id ORDER BY ln)),
k AS (SELECT *, last_value(CASE WHEN c = o THEN c::INT END IGNORE NULLS) OVER pre AS lc,
        last_value(CASE WHEN c = o THEN swaps END IGNORE NULLS) OVER pre AS ls,
        last_value(swaps) OVER pre AS before_swaps FROM s
      WINDOW pre AS (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, (coalesce(lc, 0) + coalesce(before_swaps, 0) - coalesce(ls, 0)) % 2 AS ob FROM k),
r AS (SELECT *, sum(CASE WHEN ob = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ln) AS rec,
        max(ln) OVER (PARTITION BY doc_id) AS last_ln, CASE WHEN ob = 0 THEN c ELSE o END AS open_after FROM b),
recs AS (SELECT doc_id, any_value(d) AS d, rec, string_agg(line, chr(10) ORDER BY ln)
          || CASE WHEN max(ln) = any_value(last_ln) AND arg_max(open_after, ln) AND any_value(nl) THEN chr(10) ELSE '' END AS record
        FROM r JOIN (SELECT doc_id, ends_with(text, chr(10)) AS nl FROM files) USING (doc_id) GROUP BY doc_id, rec)"""


def _file_delimiter():
    k = F.col("doc_id") % 6
    return F.when(k == 2, F.lit(";")).when(k == 3, F.lit("\t")).when(k == 4, F.lit("|")).otherwise(F.lit(","))


def _parsed_records(spark, sf):
    d = I.file_texts(spark, sf).withColumn("d", _file_delimiter())
    recs = X.csv_records(F.col("text"), F.col("d"))
    return d.select("doc_id", "d", F.posexplode(recs).alias("pos", "record"))


@query("parse_records", f"""WITH {I.FILES}, {I.LINES}, {_CSV_RECORDS}
SELECT doc_id, rec::BIGINT AS rec, record FROM recs""")
def parse_records(spark, sf):
    return _parsed_records(spark, sf).select("doc_id", (F.col("pos") + 1).cast("bigint").alias("rec"), "record")


@query("tokenize_records", f"""WITH {I.FILES}, {I.LINES}, {_CSV_RECORDS}
SELECT doc_id, rec::BIGINT AS rec, len(f) AS n_fields, array_to_string(f, '<|>') AS fields
FROM (SELECT doc_id, rec, {I.sql_fields('record', 'd')} AS f FROM recs)""")
def tokenize_records(spark, sf):
    f = _parsed_records(spark, sf).withColumn("f", X.fields("record", F.col("d")))
    return f.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("rec"), F.size("f").cast("bigint").alias("n_fields"),
                    F.array_join("f", "<|>").alias("fields"))


@query("tokenize_fields", f"""WITH {I.RECORDS}
SELECT o_orderkey, len(f) AS n_fields, array_to_string(f, '<|>') AS fields
FROM (SELECT o_orderkey, {I.sql_fields('record', "','")} AS f FROM records)""")
def tokenize_fields(spark, sf):
    f = I.order_records(spark, sf).withColumn("f", X.fields("record", ","))
    return f.select("o_orderkey", F.size("f").cast("bigint").alias("n_fields"), F.array_join("f", "<|>").alias("fields"))


_LENIENT = f"""WITH {I.RECORDS},
f AS (SELECT o_orderkey, {I.sql_fields('record', "','")} AS f FROM records)"""


@query("lenient_parse", f"""{_LENIENT}
SELECT o_orderkey, coalesce(f[1], '') AS order_id, coalesce(f[2], '') AS customer, coalesce(f[3], '') AS status,
  coalesce(f[4], '') AS priority, len(f) > 4 AS too_long, len(f) < 4 AS too_short FROM f""")
def lenient_parse(spark, sf):
    rows = P.with_conformed(I.order_records(spark, sf), F.col("record"), ",", 4)
    return P.as_table(rows, ["order_id", "customer", "status", "priority"], keep=["o_orderkey", "too_long", "too_short"])


@query("repair_counters", f"""{_LENIENT}
SELECT count(*) AS rows, count(*) FILTER (len(f) > 4) AS too_long, count(*) FILTER (len(f) < 4) AS too_short,
  count(*) FILTER (len(f) <> 4) AS repaired_rows, count(*) FILTER (len(f) <> 4) > 0 AS import_warning FROM f""")
def repair_counters(spark, sf):
    return P.repair_counters(P.with_conformed(I.order_records(spark, sf), F.col("record"), ",", 4))


@query("repaired_positions", f"""{_LENIENT}
SELECT o_orderkey, len(f) AS n_fields FROM f WHERE len(f) <> 4""")
def repaired_positions(spark, sf):
    rows = P.with_conformed(I.order_records(spark, sf), F.col("record"), ",", 4)
    return rows.filter("repaired").select("o_orderkey", F.col("n_fields").cast("bigint").alias("n_fields"))


_CELLS = f"""{_LENIENT},
c AS (SELECT o_orderkey, [coalesce(f[1], ''), coalesce(f[2], ''), coalesce(f[3], ''), coalesce(f[4], '')] AS c FROM f)"""


@query("render_rows", f"""{_CELLS}
SELECT o_orderkey, array_to_string(list_transform(c, lambda x:
  CASE WHEN regexp_matches(x, '[;"\\r\\n]') THEN '"' || replace(x, '"', '""') || '"' ELSE x END), ';') AS line FROM c""")
def render_rows(spark, sf):
    rows = P.with_conformed(I.order_records(spark, sf), F.col("record"), ",", 4)
    return rows.select("o_orderkey", X.render_row("cells", ";").alias("line"))


@query("newline_normalize", f"""WITH {I.FILES},
dos AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN replace(text, chr(10), chr(13) || chr(10)) WHEN 1 THEN replace(text, chr(10), chr(13))
  WHEN 2 THEN replace(text, chr(10), chr(13) || chr(13) || chr(10)) ELSE text END AS t FROM files)
SELECT doc_id, replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text, contains(t, chr(13)) AS changed FROM dos""")
def newline_normalize(spark, sf):
    m, t = F.col("doc_id") % 4, F.col("text")
    dos = (F.when(m == 0, F.replace(t, F.lit("\n"), F.lit("\r\n"))).when(m == 1, F.replace(t, F.lit("\n"), F.lit("\r")))
           .when(m == 2, F.replace(t, F.lit("\n"), F.lit("\r\r\n"))).otherwise(t))
    d = I.file_texts(spark, sf).select("doc_id", dos.alias("t"))
    return d.select("doc_id", X.normalize_newlines("t").alias("text"), X.newlines_changed("t").alias("changed"))


# Texts as bytes: UTF-8, UTF-8 with BOM, or one byte per character.
_VALID_UTF8_PAIRS = r"^(?:[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf])*$"


# Kind 2 has one byte per character: what doesn't fit is written as "?", some get a byte that cp1252
# doesn't define, some a pair of its quotation marks.
@query("encoding_detect", f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN text ELSE regexp_replace(text, '[^\\x00-\\xff]', '?', 'g')
    || CASE doc_id % 9 WHEN 2 THEN chr(129) WHEN 5 THEN chr(147) || chr(148) ELSE '' END END AS t FROM documents),
e AS (SELECT doc_id, t, CASE doc_id % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-8-sig'
  ELSE CASE WHEN regexp_full_match(t, '(?s){_VALID_UTF8_PAIRS}') THEN 'utf-8'
            WHEN regexp_matches(t, '[\\x81\\x8d\\x8f\\x90\\x9d]') THEN 'latin-1' ELSE 'cp1252' END END AS encoding FROM t)
SELECT doc_id, encoding, CASE encoding WHEN 'cp1252' THEN replace(replace(t, chr(147), chr(8220)), chr(148), chr(8221)) ELSE t END AS text,
  encoding <> 'utf-8' AS converted FROM e""")
def encoding_detect(spark, sf):
    m = F.col("doc_id")
    tail = F.when(m % 9 == 2, F.lit("\u0081")).when(m % 9 == 5, F.lit("\u0093\u0094")).otherwise(F.lit(""))
    single = F.concat(F.regexp_replace("text", r"[^\x00-\xff]", "?"), tail)
    raw = (F.when(m % 3 == 0, F.encode("text", "UTF-8")).when(m % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
           .otherwise(F.encode(single, "ISO-8859-1")))
    d = table(spark, sf, "documents").select("doc_id", raw.alias("raw"))
    return d.select("doc_id", X.detect_encoding("raw").alias("encoding"), X.decode_file("raw").alias("text")).withColumn(
        "converted", F.col("encoding") != "utf-8")


# --- admission: pages as uploads ---------------------------------------------

_EXT = {0: ".csv", 1: ".TSV ", 2: ".txt", 3: ".xlsx", 4: ""}
_UPLOADS = """up AS (
  SELECT page_id, url || CASE page_id % 5 WHEN 0 THEN '.csv' WHEN 1 THEN '.TSV ' WHEN 2 THEN '.txt' WHEN 3 THEN '.xlsx' ELSE '' END AS name,
    CASE WHEN page_id % 11 = 3 THEN '' ELSE html END AS body, page_id % 7 = 2 AS has_nul FROM pages)"""


def _uploads(spark, sf):
    m = F.col("page_id") % 5
    ext = F.when(m == 0, _EXT[0]).when(m == 1, _EXT[1]).when(m == 2, _EXT[2]).when(m == 3, _EXT[3]).otherwise(_EXT[4])
    body = F.when(F.col("page_id") % 11 == 3, F.lit("")).otherwise(F.col("html"))
    return table(spark, sf, "pages").select(
        "page_id", F.concat("url", ext).alias("name"), body.alias("body"), (F.col("page_id") % 7 == 2).alias("has_nul"))


@query("extension_filter", f"""WITH {_UPLOADS}
SELECT page_id, name, regexp_matches(trim(lower(name)), '\\.(csv|tsv|txt)$') AS accepted FROM up""")
def extension_filter(spark, sf):
    return _uploads(spark, sf).select("page_id", "name", L.accepted_extension("name").alias("accepted"))


@query("admission_report", f"""WITH {_UPLOADS},
c AS (SELECT page_id, octet_length(encode(body)) AS bytes, len(string_split(body, chr(10))) AS lines,
  len(body) - len(replace(body, ' ', '')) AS blanks, name, body, has_nul FROM up)
SELECT page_id, CASE WHEN bytes > 6000 THEN 'too_large' WHEN NOT regexp_matches(trim(lower(name)), '\\.(csv|tsv|txt)$') THEN 'extension'
  WHEN has_nul THEN 'binary' WHEN lines > 2 THEN 'too_many_rows' WHEN body = '' THEN 'empty'
  WHEN blanks + 1 > 300 THEN 'too_many_columns' ELSE 'accepted' END AS verdict FROM c""")
def admission_report(spark, sf):
    from ..sources.admission import admission_verdict

    raw = F.encode(F.when(F.col("has_nul"), F.concat(F.lit("a\u0000"), "body")).otherwise(F.col("body")), "UTF-8")
    u = _uploads(spark, sf).withColumn("raw", raw)
    return u.select("page_id", F.coalesce(admission_verdict(
        name="name", n_bytes=F.octet_length("body"), raw_head="raw", n_rows=F.size(F.split("body", "\n")) - 1,
        is_empty=F.col("body") == "", n_cols=X.count_char("body", " ") + 1,
        max_bytes=6000, max_rows=1, max_cols=300), F.lit("accepted")).alias("verdict"))


@query("binary_filter", """SELECT page_id, page_id % 7 = 2 AND page_id % 2 = 0 AS is_binary FROM pages""")
def binary_filter(spark, sf):
    from ..sources.admission import is_binary

    nul = F.when(F.col("page_id") % 7 == 2, F.lit("\u0000")).otherwise(F.lit("-"))
    pad = F.when(F.col("page_id") % 2 == 0, F.lit("")).otherwise(F.repeat(F.lit("é"), 2048))
    raw = F.encode(F.concat(pad, nul, "html"), "UTF-8")
    return table(spark, sf, "pages").select("page_id", is_binary(raw).alias("is_binary"))


# --- small labels -------------------------------------------------------------

@query("pseudonymize", """SELECT c_custkey, sha256(c_name)[1:12] AS name_hash FROM customer""")
def pseudonymize(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", L.pseudonym("c_name").alias("name_hash"))


@query("client_address", """WITH x AS (SELECT event_id,
  CASE event_id % 4 WHEN 0 THEN ' 10.0.0.' || user_id || ' , 10.1.1.1' WHEN 1 THEN '10.2.0.' || user_id WHEN 2 THEN '' END AS fwd,
  CASE WHEN event_id % 8 < 6 THEN '192.168.0.' || user_id END AS remote FROM events)
SELECT event_id, CASE WHEN coalesce(fwd, '') <> '' THEN trim(split_part(fwd, ',', 1)) WHEN coalesce(remote, '') <> '' THEN remote ELSE 'unknown' END AS address,
  sha256(CASE WHEN coalesce(fwd, '') <> '' THEN trim(split_part(fwd, ',', 1)) WHEN coalesce(remote, '') <> '' THEN remote ELSE 'unknown' END)[1:12] AS ip_hash FROM x""")
def client_address(spark, sf):
    m, user = F.col("event_id"), F.col("user_id").cast("string")
    fwd = (F.when(m % 4 == 0, F.concat(F.lit(" 10.0.0."), user, F.lit(" , 10.1.1.1"))).when(m % 4 == 1, F.concat(F.lit("10.2.0."), user))
           .when(m % 4 == 2, F.lit("")))
    remote = F.when(m % 8 < 6, F.concat(F.lit("192.168.0."), user))
    x = table(spark, sf, "events").select("event_id", L.client_address(fwd, remote).alias("address"))
    return x.withColumn("ip_hash", L.pseudonym("address"))


@query("output_name", """WITH x AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) WHEN 3 THEN '|' ELSE ':' END AS d FROM orders)
SELECT o_orderkey, CASE d WHEN chr(9) THEN 'TAB' WHEN ',' THEN 'Comma' WHEN ';' THEN 'Semicolon' WHEN '|' THEN 'Pipe' ELSE d END AS label,
  CASE d WHEN chr(9) THEN 'cleaned.tsv' ELSE 'cleaned.csv' END AS out_name FROM x""")
def output_name(spark, sf):
    m = F.col("o_orderkey") % 5
    d = F.when(m == 0, ",").when(m == 1, ";").when(m == 2, "\t").when(m == 3, "|").otherwise(":")
    return table(spark, sf, "orders").select("o_orderkey", d.alias("d")).select(
        "o_orderkey", L.delimiter_label(F.col("d")).alias("label"), L.output_name(F.col("d")).alias("out_name"))


@query("event_log", """SELECT event_id, '{"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","event":"' || event_type
  || '","ip_hash":"' || sha256(user_id::VARCHAR)[1:12] || '","event_id":' || event_id || ',"odd":' || (event_id % 2 = 1) || ',"user":"' || user_id || '"}' AS line FROM events""")
def event_log(spark, sf):
    from ..sources.sinks import log_lines

    """Numbers and truth values are logged as such."""
    e = table(spark, sf, "events").withColumns({
        "ip": F.col("user_id").cast("string"), "odd": F.col("event_id") % 2 == 1, "user": F.col("user_id").cast("string")})
    return log_lines(e, ts="ts", event="event_type", address="ip", fields=["event_id", "odd", "user"], keep=["event_id"])


@query("message_classes", """WITH m AS (SELECT doc_id, CASE doc_id % 8
    WHEN 0 THEN 'Fixed ' || n_chars || ' rows' WHEN 1 THEN 'Removed ' || n_chars || ' rows' WHEN 2 THEN ' Normalized names'
    WHEN 3 THEN 'Header detected on line 2' WHEN 4 THEN 'Detected encoding: ' || lang || '. Converted to UTF-8'
    WHEN 5 THEN 'Header score gap: 1.0' WHEN 6 THEN 'Quote stitching: merged 2' ELSE 'No ' || source END AS message FROM documents)
SELECT doc_id, message, CASE WHEN regexp_matches(trim(message), '^(Fixed |Removed |Normalized |Header missing|Header detected)|Converted to UTF-8|Quote stitching: merged')
  THEN 'repair' ELSE 'check' END AS class, regexp_matches(message, '^(Header candidates|Header selected|Header score gap|Header modal field count|Header chosen after tie-break)') AS is_debug FROM m""")
def message_classes(spark, sf):
    m, n = F.col("doc_id") % 8, F.col("n_chars").cast("string")
    message = (
        F.when(m == 0, F.concat(F.lit("Fixed "), n, F.lit(" rows"))).when(m == 1, F.concat(F.lit("Removed "), n, F.lit(" rows")))
        .when(m == 2, F.lit(" Normalized names")).when(m == 3, F.lit("Header detected on line 2"))
        .when(m == 4, F.concat(F.lit("Detected encoding: "), "lang", F.lit(". Converted to UTF-8")))
        .when(m == 5, F.lit("Header score gap: 1.0")).when(m == 6, F.lit("Quote stitching: merged 2"))
        .otherwise(F.concat(F.lit("No "), "source"))
    )
    d = table(spark, sf, "documents").select("doc_id", message.alias("message"))
    return d.select("doc_id", "message", L.message_class("message").alias("class"), L.is_header_debug("message").alias("is_debug"))
