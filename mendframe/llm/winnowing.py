"""Benchmark decontamination by winnowing (native).

A benchmark item gives windows of LENGTH words; an item with fewer is one window.
For windows of n words, k-grams are hashed and the smallest hash of each run
of n - k + 1 of them is kept as a fingerprint.  A window that stands in a document and in
the benchmark gives both the same fingerprint, so no shared window is missed.

Fingerprints of documents are joined to those of the benchmark; texts with a
common one are extended: all their windows are compared (128-bit hashes) with the
windows of the benchmark, which leaves exactly the true ones.  Equal texts
are extended once.  The benchmark isn't assumed to be small: its tables
are written, and Spark broadcasts them or not by their size.

Defined cases: a null text or item has no words; items without words have no
window; items without an id count for hits, not as items; equal items count by
their ids; an empty benchmark or table gives no hit or no row; other columns
are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe.functions.text import let
from mendframe.sources.workspace import Workspace

from .keys import small, text_key

LENGTH = 13
GRAM = 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]++"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASHES = "array<bigint>"


def words_of(text: Column) -> Column:
    """Words of digits, letters a-z (A-Z made small) and anything beyond ASCII."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def _fingerprints(words: Column, n: int) -> Column:
    """The smallest k-gram hash of each window of n words, without repeats; k is GRAM, or n if that is less."""
    k = min(GRAM, n)
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(F.lit(n), *(F.get(words, i + j) for j in range(k))))
    if n > k:
        least = let(grams, lambda g: F.transform(F.sequence(F.lit(0), F.size(words) - n),
                                                 lambda j: F.least(*(F.get(g, j + x) for x in range(n - k + 1)))))
    else:
        least = grams
    return F.when(F.size(words) < n, F.array().cast(HASHES)).otherwise(F.array_distinct(least))


def fingerprints(words: Column, lengths: list[int]) -> Column:
    return F.concat(*(_fingerprints(words, n) for n in lengths)) if lengths else F.array().cast(HASHES)


def windows(words: Column, n: int) -> Column:
    """(n, at, h, g) of every window of n words."""
    def one(i: Column) -> Column:
        part = [F.get(words, i + j) for j in range(n)]
        return F.struct(F.lit(n).alias("n"), i.alias("at"), F.xxhash64(F.lit(n), *part).alias("h"), F.xxhash64(F.lit("second"), *part).alias("g"))

    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), one)).otherwise(
        F.array().cast("array<struct<n:int,at:int,h:bigint,g:bigint>>"))


def benchmark_windows(items: DataFrame, work: Workspace) -> tuple[list[int], DataFrame, DataFrame]:
    """Lengths of windows (13 at most), their fingerprints (f), and windows (n, h, g, item_id)."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
    rows = rows.withColumn("length", F.least(F.size("words"), F.lit(LENGTH))).where("length > 0")
    lengths = sorted(r["length"] for r in rows.select("length").distinct().collect())  # LENGTH values at most
    own = lambda make, empty: reduce(lambda a, n: a.when(F.col("length") == n, make(n)), lengths[1:], F.when(F.col("length") == lengths[0], make(lengths[0]))).otherwise(empty) if lengths else empty
    none = F.array().cast("array<struct<n:int,at:int,h:bigint,g:bigint>>")
    prints = rows.select(F.explode(own(lambda n: _fingerprints(F.col("words"), n), F.array().cast(HASHES))).alias("f")).distinct()
    found = rows.select("item_id", F.explode(own(lambda n: windows(F.col("words"), n), none)).alias("w")).select(
        "w.n", "w.h", "w.g", "item_id").distinct()
    return lengths, work.save(prints, "benchmark_prints"), work.save(found, "benchmark_windows")


def overlaps(docs: DataFrame, items: DataFrame, work: Workspace) -> DataFrame:
    """(doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated) of every document; key is a hash of the text."""
    lengths, prints, known = benchmark_windows(items, work)
    docs = docs.select("doc_id", text_key("text").alias("key"), "text")
    read = docs.withColumn("words", words_of(F.col("text")))
    rows = work.save(read.select("doc_id", "key", F.size("words").cast("long").alias("n_words"),
                                 fingerprints(F.col("words"), lengths).alias("prints")), "document_prints")
    shared = rows.select("key", F.explode("prints").alias("f")).join(prints, "f", "left_semi").select("key").distinct()
    shared = work.save(shared, "shared")

    texts = docs.select("key", "text").join(small(shared), "key", "left_semi").dropDuplicates(["key"])
    texts = work.save(texts, "shared_texts").withColumn("words", words_of(F.col("text")))
    every = F.concat(*(windows(F.col("words"), n) for n in lengths)) if lengths else F.array().cast("array<struct<n:int,at:int,h:bigint,g:bigint>>")
    hits = texts.select("key", F.explode(every).alias("w")).select("key", "w.*")
    hits = work.save(hits.join(known.select("n", "h", "g").distinct(), ["n", "h", "g"], "left_semi"), "hits")

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    places = F.sort_array(F.collect_list(F.struct("at", "n")))
    covered = F.aggregate(places, start, lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0), x["at"] + x["n"] - F.greatest(a["end"], x["at"]))).alias("n"),
        F.greatest(a["end"], x["at"] + x["n"]).alias("end")))
    n_hit = work.save(hits.groupBy("key").agg(covered["n"].cast("long").alias("n_hit")), "n_hit")
    of = hits.select("key", "n", "h", "g").distinct().join(known.where("item_id IS NOT NULL"), ["n", "h", "g"]).select("key", "item_id").distinct()
    named = work.save(of.groupBy("key").agg(F.sort_array(F.collect_list("item_id")).alias("items")), "items")
    found = work.save(n_hit.join(named, "key", "left"), "found")
    rows = work.save(rows.select("doc_id", "key", "n_words"), "document_words")
    for done in ("document_prints", "shared_texts", "hits"):
        work.drop(done)

    items_ = F.coalesce("items", F.array().cast("array<string>"))
    out = rows.select("doc_id", "key", "n_words").join(found, "key", "left").select(
        "doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_, ",").cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean_documents(docs: DataFrame, items: DataFrame, work: Workspace) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated."""
    bad = overlaps(docs, items, work).where("contaminated").select(F.col("key").alias("_bad")).distinct()
    bad = small(work.save(bad, "contaminated"))
    return docs.withColumn("_mf_key", text_key("text")).join(bad, F.col("_mf_key") == F.col("_bad"), "left_anti").select(
        *(F.col(f"`{c}`") for c in docs.columns))
