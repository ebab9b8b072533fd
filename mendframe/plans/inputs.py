"""Inputs derived from the given tables, once for Spark and once as SQL.

The tables are clean, so damage is added by key arithmetic that both engines
can express: every document becomes a delimited file of one of six kinds, and
every order a delimited record that may be ragged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

# --- documents as files ----------------------------------------------------
# kind 0: the text as it is         kind 3: tabs under a header
# kind 1: preamble, header, commas  kind 4: pipes, no header
# kind 2: semicolons, EU numbers    kind 5: one quoted multi-line field, ragged rows

_TWO_WORDS = r"(?m)^(\S+) (\S+) "


def file_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): one delimited file per document."""
    text = F.col("text")
    kind = F.col("doc_id") % 6
    shaped = (
        F.when(kind == 1, F.concat(F.lit("Report: "), "source", F.lit("\nGenerated "), "lang", F.lit("\nid,name,amount\n"),
                                   F.regexp_replace(text, _TWO_WORDS, "$1,$2,")))
        .when(kind == 2, F.concat(F.lit("id;amount;name;note\n"), F.regexp_replace(text, _TWO_WORDS, "$1;12,34;$2;")))
        .when(kind == 3, F.concat(F.lit("name\tvalue\tnote\n"), F.regexp_replace(text, _TWO_WORDS, "$1\t$2\t")))
        .when(kind == 4, F.regexp_replace(text, _TWO_WORDS, "$1|$2|"))
        .when(kind == 5, F.concat(F.lit('key,"'), F.replace(text, F.lit('"'), F.lit('""')),
                                  F.lit('",end\n1,2,3,4\n5\n'), "lang", F.lit(","), "source", F.lit("\n")))
        .otherwise(text)
    )
    return table(spark, sf_dir, "documents").select("doc_id", shaped.alias("text"))


FILES = r"""files AS (
  SELECT doc_id, CASE doc_id % 6
    WHEN 1 THEN 'Report: ' || source || chr(10) || 'Generated ' || lang || chr(10) || 'id,name,amount' || chr(10)
                || regexp_replace(text, '(?m)^(\S+) (\S+) ', '\1,\2,', 'g')
    WHEN 2 THEN 'id;amount;name;note' || chr(10) || regexp_replace(text, '(?m)^(\S+) (\S+) ', '\1;12,34;\2;', 'g')
    WHEN 3 THEN 'name' || chr(9) || 'value' || chr(9) || 'note' || chr(10)
                || regexp_replace(text, '(?m)^(\S+) (\S+) ', '\1' || chr(9) || '\2' || chr(9), 'g')
    WHEN 4 THEN regexp_replace(text, '(?m)^(\S+) (\S+) ', '\1|\2|', 'g')
    WHEN 5 THEN 'key,"' || replace(text, '"', '""') || '",end' || chr(10) || '1,2,3,4' || chr(10) || '5' || chr(10)
                || lang || ',' || source || chr(10)
    ELSE text END AS text
  FROM documents)"""

# physical lines, numbered from 0; a final newline opens no further line
LINES = r"""parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM files),
lines AS (
  SELECT doc_id, ln, line FROM (
    SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS ln, len(p) AS n FROM parts)
  WHERE NOT (ln = n - 1 AND line = ''))"""

# detection sample: non-blank lines of the first 16,384 characters, 30 at most
SAMPLE = r"""sample_parts AS (SELECT doc_id, string_split(substring(text, 1, 16384), chr(10)) AS p FROM files),
sample_all AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM (
    SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS pos FROM sample_parts)
  WHERE regexp_matches(line, '\S')),
sample AS (SELECT doc_id, i, line FROM sample_all WHERE i <= 30)"""

CANDIDATES = """cand(d, pos, pref) AS (VALUES (',', 0, 0), (';', 1, 2), (chr(9), 2, 1), ('|', 3, 3))"""


def sql_raw_fields(line: str, d: str) -> str:
    """SQL list of the raw fields of a line for a delimiter expression."""
    def one(ch: str, esc: str) -> str:
        return (f"regexp_extract_all({ch} || {line}, "
                f"'{esc}(\"[^\"]*(?:\"\"[^\"]*)*(?:\"[^{esc}]*|\\z)|[^{esc}]*)', 1)")

    return (f"(CASE {d} WHEN ',' THEN {one(repr(','), ',')} WHEN ';' THEN {one(repr(';'), ';')} "
            f"WHEN chr(9) THEN {one('chr(9)', chr(92) + 't')} ELSE {one(repr('|'), chr(92) + '|')} END)")


def sql_fields(line: str, d: str) -> str:
    """SQL list of the unquoted fields; an empty line has none."""
    return (f"(CASE WHEN {line} = '' THEN []::VARCHAR[] ELSE list_transform({sql_raw_fields(line, d)}, lambda x: "
            "CASE WHEN x[1] = '\"' THEN replace(regexp_extract(x, '^\"([^\"]*(?:\"\"[^\"]*)*)', 1), '\"\"', '\"') "
            "|| regexp_replace(x, '^\"[^\"]*(?:\"\"[^\"]*)*\"?', '') ELSE x END) END)")


# --- orders as delimited records -------------------------------------------
# width 4; every 7th record has a field too many, the next one too few

def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, record): one comma-delimited record per order."""
    m = F.col("o_orderkey") % 7
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    quoted = F.concat(F.lit('"'), "o_orderstatus", F.lit(', ""'), "o_orderpriority", F.lit('"""'))
    record = (
        F.when(m == 0, F.concat_ws(",", key, cust, quoted, "o_orderpriority", F.lit("EXTRA")))
        .when(m == 1, F.concat_ws(",", key, quoted))
        .when(m == 2, F.concat_ws(",", key, cust, F.lit('5" pipe'), F.lit("")))
        .otherwise(F.concat_ws(",", key, cust, quoted, "o_orderpriority"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", record.alias("record"))


RECORDS = r"""records AS (
  SELECT o_orderkey, CASE o_orderkey % 7
    WHEN 0 THEN o_orderkey || ',' || o_custkey || ',"' || o_orderstatus || ', ""' || o_orderpriority || '""' || '",' || o_orderpriority || ',EXTRA'
    WHEN 1 THEN o_orderkey || ',"' || o_orderstatus || ', ""' || o_orderpriority || '""' || '"'
    WHEN 2 THEN o_orderkey || ',' || o_custkey || ',5" pipe,'
    ELSE o_orderkey || ',' || o_custkey || ',"' || o_orderstatus || ', ""' || o_orderpriority || '""' || '",' || o_orderpriority END AS record
  FROM orders)"""


# --- localized amounts -------------------------------------------------------

def localized_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, eu, us, mixed, code, note): order prices as text."""
    us = F.format_number(F.col("o_totalprice"), 2)
    eu = F.translate(us, ",.", ".,")
    m = F.col("o_orderkey") % 5
    mixed = (
        F.when(m == 0, F.concat(F.lit("("), eu, F.lit(")"))).when(m == 1, F.concat(F.lit(" $"), us))
        .when(m == 2, F.concat(eu, F.lit(" €"))).when(m == 3, F.lit("  ")).otherwise(us)
    )
    code = F.when(F.col("o_orderkey") % 6 == 0, F.lit("n/a")).otherwise((F.col("o_orderkey") % 900).cast("string"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", eu.alias("eu"), us.alias("us"), mixed.alias("mixed"), code.alias("code"),
        F.col("o_orderpriority").alias("note"))


AMOUNTS = r"""amounts0 AS (SELECT *, format('{:,.2f}', o_totalprice) AS us FROM orders),
amounts AS (
  SELECT o_orderkey, translate(us, ',.', '.,') AS eu, us,
    CASE o_orderkey % 5 WHEN 0 THEN '(' || translate(us, ',.', '.,') || ')' WHEN 1 THEN ' $' || us
      WHEN 2 THEN translate(us, ',.', '.,') || ' €' WHEN 3 THEN '  ' ELSE us END AS mixed,
    CASE WHEN o_orderkey % 6 = 0 THEN 'n/a' ELSE (o_orderkey % 900)::VARCHAR END AS code,
    o_orderpriority AS note
  FROM amounts0)"""


def sql_number(x: str) -> str:
    """SQL value of a localized number."""
    t = f"trim({x}, ' ' || chr(9))"
    neg = f"(starts_with({t}, '(') AND ends_with({t}, ')'))"
    inner = f"CASE WHEN {neg} THEN trim({t}[2:-2]) ELSE {t} END"
    bare = f"trim(replace(replace(replace({inner}, '$', ''), '€', ''), '£', ''))"
    return (f"(CASE WHEN {neg} THEN -1 ELSE 1 END * CASE "
            f"WHEN regexp_matches({bare}, '^\\(?-?\\d{{1,3}}([.\\s]\\d{{3}})*,\\d+\\)?$') "
            f"THEN TRY_CAST(replace(replace(replace({bare}, ' ', ''), '.', ''), ',', '.') AS DOUBLE) "
            f"WHEN regexp_matches({bare}, '^\\(?-?\\d{{1,3}}(,\\d{{3}})*(\\.\\d+)?\\)?$') "
            f"THEN TRY_CAST(replace({bare}, ',', '') AS DOUBLE) END)")


# --- a messy catalogue -------------------------------------------------------

def messy_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with padded cells, mixed case and blank rows; key ``p_partkey``.

    Column names are messy too: `` Part Name ``, ``Part-Type (x)``, ``Part Type x``.
    """
    m = F.col("p_partkey") % 4
    name = (
        F.when(F.col("p_partkey") % 50 == 7, F.lit("  ")).when(m == 0, F.concat(F.lit("  "), "p_name", F.lit("\t")))
        .when(m == 1, F.upper("p_name")).when(m == 2, F.replace("p_name", F.lit(" "), F.lit(" \t "))).otherwise(F.col("p_name"))
    )
    kind = F.when(F.col("p_partkey") % 50 == 7, F.lit("")).when(m == 3, F.concat("p_type", F.lit(" "))).otherwise(F.col("p_type"))
    updated = F.when(F.col("p_partkey") % 50 == 7, F.lit("")).otherwise(F.concat(F.lit("2024-01-0"), (F.col("p_partkey") % 9 + 1).cast("string")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", name.alias(" Part Name "), kind.alias("Part-Type (x)"), updated.alias("Updated At"), kind.alias("PartType x"))


PARTS = r"""parts0 AS (
  SELECT p_partkey,
    CASE WHEN p_partkey % 50 = 7 THEN '  ' WHEN p_partkey % 4 = 0 THEN '  ' || p_name || chr(9)
      WHEN p_partkey % 4 = 1 THEN upper(p_name) WHEN p_partkey % 4 = 2 THEN replace(p_name, ' ', ' ' || chr(9) || ' ')
      ELSE p_name END AS name,
    CASE WHEN p_partkey % 50 = 7 THEN '' WHEN p_partkey % 4 = 3 THEN p_type || ' ' ELSE p_type END AS kind,
    CASE WHEN p_partkey % 50 = 7 THEN '' ELSE '2024-01-0' || (p_partkey % 9 + 1) END AS updated
  FROM part),
trimmed AS (
  SELECT p_partkey, trim(name, ' ' || chr(9)) AS part_name, trim(kind, ' ' || chr(9)) AS parttype_x,
    updated AS updated_at, trim(kind, ' ' || chr(9)) AS parttype_x_2
  FROM parts0)"""

FOLD = r"lower(trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g')))"
