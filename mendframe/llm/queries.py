"""Queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendframe.plans.registry import table
from mendframe.sources.workspace import Workspace

from . import fill_middle, lexical_search, masked_lm, web_archive, near_copies, packing, private_data, quality_rules, quote_links, rank_order, secret_scan, slots, winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


@query("op1_virtual_slots")
def virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = slots.shard(table(spark, sf_dir, "documents"), 24, Workspace(spark))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")


@query("op2_quote_links")
def quote_links_of_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of all conversations as mails that quote the two turns before them, linked by the quotes alone."""
    mails = quote_links.as_mails(table(spark, sf_dir, "conversations"))
    return quote_links.conversations(mails, Workspace(spark))


@query("op3_weak_supervision")
def weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.find(table(spark, sf_dir, "documents"), Workspace(spark)).drop("found")


@query("op4_similarity_sketch")
def similarity_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.components_of(table(spark, sf_dir, "documents"), 2, Workspace(spark)).drop("key", "root")


@query("op5_decision_list")
def decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Workspace(spark))


@query("op6_markov_secrets")
def markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find(table(spark, sf_dir, "documents"), Workspace(spark)).drop("found")


@query("op7_winnowing")
def winnowed_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Workspace(spark)).drop("key")


@query("op8_bin_slack")
def bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), Workspace(spark))


@query("op9_masked_likelihood")
def masked_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.learn_and_score(table(spark, sf_dir, "documents"), Workspace(spark))


@query("op10_rank_order")
def rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_order.learn_and_identify(table(spark, sf_dir, "documents"))

#: Units by splitting at newlines; prefix_k is the text of the first k units.
OP11_SQL = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS parts,
           sha256('7:' || CAST(doc_id AS VARCHAR)) AS h
    FROM documents
), c AS (
    SELECT *, CAST(len(parts) - CASE WHEN parts[len(parts)] = '' THEN 1 ELSE 0 END AS BIGINT) AS n,
           CAST(('0x' || substr(h, 1, 8)) AS UBIGINT) AS h1, CAST(('0x' || substr(h, 9, 8)) AS UBIGINT) AS h2,
           CAST(('0x' || substr(h, 17, 8)) AS UBIGINT) AS h3, CAST(('0x' || substr(h, 25, 8)) AS UBIGINT) AS h4
    FROM d
), k AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           (t = '' OR doc_id IS NULL OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100) AS plain
    FROM c
), u AS (
    SELECT *,
           CASE WHEN a = 0 THEN '' WHEN a < len(parts) THEN array_to_string(parts[1:a], chr(10)) || chr(10) ELSE t END AS upto_a,
           CASE WHEN b = 0 THEN '' WHEN b < len(parts) THEN array_to_string(parts[1:b], chr(10)) || chr(10) ELSE t END AS upto_b
    FROM k
), p AS (
    SELECT *, upto_a AS prefix, substr(upto_b, length(upto_a) + 1) AS middle, substr(t, length(upto_b) + 1) AS suffix FROM u
)
SELECT doc_id, n,
       CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN plain THEN NULL ELSE CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN plain THEN NULL ELSE CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE WHEN plain THEN t
                   WHEN h4 % 100 < 50 THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                   ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


@query("op11_block_rotation", OP11_SQL)
def block_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in fill-in-the-middle form, with digests of the output and of the text restored from it."""
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("fim_n").alias("n"), F.col("fim_form").alias("form"),
                       F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"),
                       F.sha2(F.col("fim_text").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(fill_middle.restored().cast("binary"), 256).alias("restored_sha256"))


OP13_SQL = """
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts
    FROM documents
), dn AS (
    SELECT rid, doc_id, ts, CAST(len(ts) AS BIGINT) AS n FROM d
), st AS (
    SELECT CAST(count(*) FILTER (WHERE n > 0) AS BIGINT) AS big_n, CAST(coalesce(sum(n), 0) AS BIGINT) AS big_l FROM dn
), tf AS (
    SELECT rid, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT rid, doc_id, n, unnest(ts) AS term FROM dn) GROUP BY ALL
), df AS (
    SELECT term, count(*) AS df FROM tf GROUP BY term
), q AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM benchmark
), w AS (
    SELECT q.item_id, q.term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * df.df + 1))) AS BIGINT) AS w
    FROM q JOIN df USING (term), st
), s AS (
    SELECT w.item_id, tf.rid, tf.doc_id,
           sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * tf.n * big_n) // big_l))))::BIGINT AS score
    FROM w JOIN tf USING (term), st GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM s WHERE score > 0
) WHERE rank <= 10
"""


@query("op13_max_sketch_search", OP13_SQL)
def max_sketch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item, from block max-sketches and exact rescoring."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Workspace(spark))


OP12_SQL = """
WITH p AS (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), h AS (
    SELECT payload_digest, max(page_id) AS head FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN h.head IS NOT NULL AND p.page_id <> h.head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN h.head IS NOT NULL AND p.page_id <> h.head THEN h.head END AS refers_to
FROM p LEFT JOIN h USING (payload_digest)
"""


@query("op12_arc_to_warc", OP12_SQL)
def arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as ARC, converted to WARC with revisits of equal payloads, and read back."""
    return web_archive.archive_round_trip(table(spark, sf_dir, "pages"), Workspace(spark))
