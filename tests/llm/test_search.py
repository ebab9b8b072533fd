"""Ranked lexical search against a plain scoring of every document for every query."""

import math
import re
from collections import Counter

from brute import awkward, rows

from mendframe.llm import keys, lexical_search
from mendframe.llm.queries import QUERIES
from mendframe.sources.workspace import Workspace

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items):
    bags = [(d, Counter(TERM.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))))
            for d, t in docs]
    N = sum(1 for _, c in bags if c)
    L = sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    by_item = {}
    for i, t in items:
        by_item.setdefault(i, set()).update(TERM.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))))
    for i, terms in by_item.items():
        scored = []
        for d, c in bags:
            n = sum(c.values())
            m = 10 + (90 * n * N) // L if L else 10
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in terms if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        for r, (neg, _, _, d) in enumerate(sorted(scored)[:10], 1):
            out.append((i, r, d, -neg))
    return sorted(out, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def ranked(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


TEXTS = [None, "", "Apple apple APPLE pie", "apple pie", "apple pie", "pie", "ÄPFEL äpfel 42 pie", "x" * 5000, "the the the pie apple",
         "pie apple " * 2000, "1234 apple", "...", "Pie", "apple", "apple"]


def test_awkward_documents_against_plain(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 3)
    monkeypatch.setattr(lexical_search, "COORDS", 8)      # collisions on purpose
    ids = [0, 1, 2, 3, 3, 5, 6, 7, None, 9, 10, 11, 12, 13, 14]   # a repeated row and a null id
    docs = awkward(spark, TEXTS, ids)
    items = [(1, "apple PIE"), (2, "äpfel 42"), (3, None), (4, "nothing here"), (None, "pie"), (1, "apple again")]
    q = spark.createDataFrame(items, "item_id long, text string")
    got = ranked(lexical_search.search(docs, q, Workspace(spark)))
    assert got == plain_search(list(zip(ids, TEXTS)), items)


def test_threshold_prunes_and_stays_exact(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 4)
    monkeypatch.setattr(lexical_search, "SEED_BLOCKS", 1)
    texts = [f"common words here {'rare' if i % 37 == 0 else 'plain'} {i % 5}" for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    items = [(7, "rare words"), (8, "common"), (9, "3 plain")]
    q = spark.createDataFrame(items, "item_id long, text string")
    assert ranked(lexical_search.search(docs, q, Workspace(spark))) == plain_search(list(enumerate(texts)), items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(docs, q, Workspace(spark)).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert lexical_search.search(awkward(spark, ["a b"]), none, Workspace(spark)).count() == 0


def test_query_whole_tables(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert ranked(QUERIES["op13_max_sketch_search"](spark, sf)) == plain_search(docs, items)


def test_python_gets_small_batches(spark, monkeypatch):
    """Every job with rows in Python runs in batches of SLICE rows, and the result that is left has none."""
    monkeypatch.setattr(lexical_search, "SLICE", 7)
    seen, before = [], spark.conf.get(keys.ARROW_ROWS)

    class Watched(Workspace):
        def save(self, df, name):
            seen.append(int(spark.conf.get(keys.ARROW_ROWS)))
            return super().save(df, name)

    texts = [f"common word {i % 3}" for i in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    items = [(1, "common 2"), (2, "word")]
    got = lexical_search.search(docs, spark.createDataFrame(items, "item_id long, text string"), Watched(spark))
    assert seen and max(seen) == 7 and spark.conf.get(keys.ARROW_ROWS) == before
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    assert ranked(got) == plain_search(list(enumerate(texts)), items)
