"""Ranked lexical search: block max-sketches give upper bounds, exact rescoring in descending bound order to a threshold.

Scoring (integer, BM25-like): a document's terms are the maximal matches of
``TERM`` with only A-Z lower-cased; ``N`` counts the documents that hold a
term, ``L`` all their terms, ``n`` one document's terms, ``df`` the documents
holding a term and ``tf`` its occurrences in one.  A term weighs
``w = floor(1000 ln((2N + 2) / (2 df + 1)))``; a document has
``m = 10 + (90 n N) div L``; its score for a query sums
``w * ((10^9 tf) div (1000 tf + 8 m))`` over the query's distinct terms.

Method:

1. *Bags*, one Python pass over the texts (written): each document's distinct
   terms with counts and sketch coordinates, and its block: documents are taken
   in blocks of ``BLOCK_DOCS`` where they stand (no shuffle).  ``N`` and ``L``
   are one aggregate over the bags' ``n``.
2. *Max-sketches*, numpy over the Arrow buffers of the bags: each document's impacts
   ``(10^9 tf) div (1000 tf + 8 m)`` are folded into ``COORDS`` hashed
   coordinates of its block by maxima (one byte each, rounded up to
   ``STEP``), so for any term ``t`` and document ``d`` of the block, its
   impact is at most the sketch at ``crc32(t) mod COORDS``.
3. *Upper bounds*: queries are looked up in batches, one matrix product per
   batch of blocks: ``bound = sum of w(t) * sketch[coord(t)]`` over the query's
   terms.  ``w >= 0``, so no document of the block scores above it.
4. *Seeds*: the ``SEED_BLOCKS`` blocks of highest bound of each query are
   scored exactly; the 10th best score (or 1 when fewer than 10 score above 0)
   is the query's threshold.
5. *Rescoring until the threshold*: every other block whose bound reaches the
   threshold is scored exactly.  All blocks left have bounds below the 10th
   best score, so the top 10 is exact.  Exact scores are vectorised: the
   postings of query terms in a batch of documents are spread over their
   queries by a term-to-(query, weight) list and summed by ``bincount``;
   each batch's 10 best per query go on to the final ranking.

Measured: on the check tables the 10th best score of an item is that of an
ordinary document, and block maxima of common terms reach it, so most blocks
stay candidates there; results are exact either way, and the rescoring is
what keeps the cost down.

Scale: bags and sketches are written (shared folder), no step shuffles texts,
the only shuffles are the ``df`` count of query terms (map-side combined, so
a very frequent term is a few partial counts), the semi-join of bags with the
candidate blocks (broadcast up to a counted number) and the final ranking
over at most 10 rows per batch and query, those below the 10th best that the
task has seen left out.  Jobs that hand rows to Python do so in Arrow batches of
``SLICE`` rows and end in a written table, so neither the JVM nor a worker holds
more rows than that at once.  Queries are taken ``ITEMS_PER_PASS`` at a time, so the matrix and
term lists that go to the workers are bounded.

Defined cases:

* null or empty text, or no term: ``n = 0``, not counted in ``N``, never a result.
* very long texts: counted whole in one pass; a bag holds the distinct terms only.
* ties: equal scores by ascending ``doc_id``, nulls last; ranks unique.
* repeated rows: each row is a document of its own; the same ``doc_id`` may be ranked twice.
* null ``doc_id``: a document like any other, ranked after equal scores.
* queries: grouped by ``item_id`` (null is one group), their distinct terms once each; no term, no result.
* empty tables: no rows.  Extra columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mendframe.sources.workspace import Workspace

from . import keys

# fixed values of the contract: term pattern, folded letters, constants of the score
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOP = 10

#: Documents of a block, hashed coordinates of its sketch (one byte each), blocks scored first per query.
BLOCK_DOCS = 64
COORDS = 65536
SEED_BLOCKS = 2
#: Impacts are below 10^6; a sketch byte q stands for impacts up to q * STEP (rounded up, so bounds stay bounds).
STEP = 3922
#: Rows handed to Python (one Arrow batch) and turned into Python objects at once.
SLICE = 256
#: Terms whose coordinates a worker remembers; beyond that it starts afresh.
MEMORY = 200_000
#: Queries looked up per pass (their terms and weights go to the workers with the code).
ITEMS_PER_PASS = 200

INDEX_SCHEMA = "block long, doc_id long, n long, terms array<string>, tfs array<long>, coords array<int>"


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(LOWER))


def weight(N: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * N + 2) / (2 * df + 1)))


def doc_m(n: int, N: int, L: int) -> int:
    return 10 + (90 * n * N) // L if L else 10


def impact(tf: int, m: int) -> int:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def coord(term: str) -> int:
    return zlib.crc32(term.encode()) % COORDS


def index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Bags: each document's distinct terms, counts and sketch coordinates, with its block (documents where they stand)."""
    def run(batches):
        part = TaskContext.get().partitionId()
        cache: dict[str, int] = {}
        seen = 0
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                if len(cache) > MEMORY:
                    cache.clear()
                cs = [Counter(terms_of(t)) for t in b.column(1).to_pylist()]
                blocks = [(part << 32) | ((seen + k) // BLOCK_DOCS) for k in range(len(cs))]
                seen += len(cs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blocks, pa.int64()), b.column(0), pa.array([sum(c.values()) for c in cs], pa.int64()),
                     pa.array([list(c) for c in cs], pa.list_(pa.string())), pa.array([list(c.values()) for c in cs], pa.list_(pa.int64())),
                     pa.array([[cache[x] if x in cache else cache.setdefault(x, coord(x)) for x in c] for c in cs], pa.list_(pa.int32()))],
                    names=["block", "doc_id", "n", "terms", "tfs", "coords"])

    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
            .mapInArrow(run, INDEX_SCHEMA))


def sketches(bagged: DataFrame, N: int, L: int) -> DataFrame:
    """(block, sketch): max-sketch of the impacts of each block's documents, by numpy over the Arrow buffers.

    A block read in two pieces gives two rows; each bounds its own documents.
    """
    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            block = b.column(0).to_numpy(zero_copy_only=False)
            n = b.column(1).to_numpy(zero_copy_only=False)
            tfs, coords = b.column(2), b.column(3)
            tf = tfs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            cs = coords.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = pc.list_parent_indices(tfs).to_numpy(zero_copy_only=False)
            m = 10 + (90 * n * N) // L if L else np.full(len(n), 10, np.int64)
            q = (-(-impacts(tf, m[doc]) // STEP)).astype(np.uint8)
            ids, local = np.unique(block, return_inverse=True)
            sketch = np.zeros(len(ids) * COORDS, np.uint8)
            np.maximum.at(sketch, local[doc] * COORDS + cs, q)
            sketch = sketch.reshape(len(ids), COORDS)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([r.tobytes() for r in sketch], pa.binary())],
                                             names=["block", "sketch"])

    return bagged.select("block", "n", "tfs", "coords").mapInArrow(run, "block long, sketch binary")


def bags(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n, terms, tfs): each text's distinct terms with their counts."""
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                cs = [Counter(terms_of(t)) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([sum(c.values()) for c in cs], pa.int64()), pa.array([list(c) for c in cs], pa.list_(pa.string())),
                     pa.array([list(c.values()) for c in cs], pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n long, terms array<string>, tfs array<long>"))


class Queries:
    """One pass of queries: ids, weighted distinct terms, bound matrix by coordinate, and term to (query, weight) lists."""

    def __init__(self, items: list, terms: list[list[str]], df: dict[str, int], N: int):
        self.items = items
        self.weighted = [[(t, weight(N, df.get(t, 0))) for t in ts] for ts in terms]
        used = sorted({coord(t) for ts in terms for t in ts})
        self.coords = np.array(used, np.int64)
        at = {c: i for i, c in enumerate(used)}
        self.matrix = np.zeros((len(used), len(items)), np.float64)
        by_term: dict[str, list] = {}
        for j, ws in enumerate(self.weighted):
            for t, w in ws:
                self.matrix[at[coord(t)], j] += w
                by_term.setdefault(t, []).append((j, w))
        self.vocab = pa.array(list(by_term), pa.string())
        lists = list(by_term.values())
        self.ptr = np.cumsum([0] + [len(x) for x in lists])
        self.qs = np.array([j for x in lists for j, _ in x], np.int64)
        self.ws = np.array([w for x in lists for _, w in x], np.float64)

    def bounds(self, sketches: list[bytes]) -> np.ndarray:
        """(blocks x queries): sums of integers below 2^53, exact in doubles."""
        s = np.stack([np.frombuffer(x, np.uint8) for x in sketches])[:, self.coords].astype(np.float64)
        return (s * STEP) @ self.matrix

    def scores(self, n: np.ndarray, terms: pa.Array, tfs: pa.Array, N: int, L: int) -> np.ndarray:
        """(documents x queries) exact scores, from the postings of query terms alone."""
        nq = len(self.items)
        flat = terms.flatten()
        idx = pc.index_in(flat, value_set=self.vocab)
        hit = pc.is_valid(idx)
        rows = pc.list_parent_indices(terms).filter(hit).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(rows) == 0:
            return np.zeros((len(n), nq), np.int64)
        idx = idx.filter(hit).to_numpy(zero_copy_only=False).astype(np.int64)
        tf = tfs.flatten().filter(hit).to_numpy(zero_copy_only=False).astype(np.int64)
        m = (10 + (90 * n * N) // L if L else np.full(len(n), 10, np.int64))[rows]
        g = impacts(tf, m)
        counts = self.ptr[idx + 1] - self.ptr[idx]
        pair_doc = np.repeat(rows, counts)
        starts = np.repeat(self.ptr[idx], counts)
        offs = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        slot = starts + offs
        flat_at = pair_doc * nq + self.qs[slot]
        # exact: each term below 2.6e10, sums below 2^53
        total = np.bincount(flat_at, weights=np.repeat(g, counts).astype(np.float64) * self.ws[slot], minlength=len(n) * nq)
        return total.reshape(len(n), nq).astype(np.int64)


def _seeds(sketches: DataFrame, q: Queries) -> DataFrame:
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                if b.num_rows == 0:
                    continue
                bound = q.bounds(b.column(1).to_pylist())
                ids = np.array(b.column(0).to_pylist(), np.int64)
                k = min(SEED_BLOCKS, len(ids))
                top = np.argpartition(-bound, k - 1, axis=0)[:k]
                qi, bi, bd = [], [], []
                for j in range(bound.shape[1]):
                    for i in top[:, j]:
                        if bound[i, j] > 0:
                            qi.append(j)
                            bi.append(int(ids[i]))
                            bd.append(int(bound[i, j]))
                yield pa.RecordBatch.from_arrays([pa.array(qi, pa.int32()), pa.array(bi, pa.int64()), pa.array(bd, pa.int64())],
                                                 names=["q", "block", "bound"])

    local = sketches.select("block", "sketch").mapInArrow(run, "q int, block long, bound long")
    w = Window.partitionBy("q").orderBy(F.desc("bound"), "block")
    return local.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= SEED_BLOCKS).select("block").distinct()


def _candidates(sketches: DataFrame, q: Queries, threshold: np.ndarray) -> DataFrame:
    """Blocks whose bound reaches the threshold of any query."""
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                if b.num_rows == 0:
                    continue
                hit = (q.bounds(b.column(1).to_pylist()) >= threshold[None, :]).any(axis=1)
                ids = np.array(b.column(0).to_pylist(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit])], names=["block"])

    return sketches.select("block", "sketch").mapInArrow(run, "block long").distinct()


def _rescored(bagged: DataFrame, wanted: DataFrame, q: Queries, N: int, L: int) -> DataFrame:
    """(q, doc_id, score): exact scores of the documents of the wanted blocks, the 10 best of each batch and query.

    A task remembers the 10 best scores it has seen for each query and leaves
    out what lies below them; equal scores stay, the final ranking orders them.
    """
    def run(batches):
        best = np.zeros((TOP, len(q.items)), np.int64)  # ascending
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                doc_ids = b.column(0).to_pylist()
                score = q.scores(b.column(1).to_numpy(zero_copy_only=False), b.column(2), b.column(3), N, L)
                order = np.array(sorted(range(len(doc_ids)), key=lambda k: (doc_ids[k] is None, doc_ids[k] or 0)), np.int64)
                rows = order[np.argsort(-score[order], axis=0, kind="stable")[:TOP]]
                top = np.take_along_axis(score, rows, axis=0)
                some, js = np.nonzero((top > 0) & (top >= best[0]))
                best = np.sort(np.vstack([best, top]), axis=0)[-TOP:]
                yield pa.RecordBatch.from_arrays([pa.array(js.astype(np.int32)), pa.array([doc_ids[k] for k in rows[some, js]], pa.int64()), pa.array(top[some, js])],
                                                 names=["q", "doc_id", "score"])

    picked = bagged.join(keys.small(wanted), "block", "left_semi")
    return picked.select("doc_id", "n", "terms", "tfs").mapInArrow(run, "q int, doc_id long, score long")


def _top(scored: DataFrame) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= TOP)


def search(docs: DataFrame, queries: DataFrame, work: Workspace, text: str = "text", doc_id: str = "doc_id",
           query_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): each query's 10 best documents with a score above 0."""
    with keys.arrow_rows(docs.sparkSession, SLICE):
        return _search(docs, queries, work, text, doc_id, query_text, item_id)


def _search(docs: DataFrame, queries: DataFrame, work: Workspace, text: str, doc_id: str, query_text: str, item_id: str) -> DataFrame:
    spark = docs.sparkSession
    bagged = work.save(index(docs, text, doc_id), "search_bags")
    stats = bagged.agg(F.count(F.when(F.col("n") > 0, 1)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    N, L = int(stats["N"]), int(stats["L"])
    sketched = work.save(sketches(bagged, N, L), "search_sketches")

    item_terms = work.save(bags(queries, query_text, item_id).select(
        F.col("doc_id").alias("item_id"), F.explode("terms").alias("term")).distinct(), "search_items")
    item_ids = [r[0] for r in item_terms.select("item_id").distinct().orderBy(F.asc_nulls_first("item_id")).collect()]
    results = []
    for start in range(0, len(item_ids), ITEMS_PER_PASS):
        chunk = item_ids[start:start + ITEMS_PER_PASS]
        picked = item_terms.filter(F.col("item_id").isin([i for i in chunk if i is not None])
                                   | (F.col("item_id").isNull() if None in chunk else F.lit(False)))
        got: dict = {}
        for r in picked.collect():
            got.setdefault(r["item_id"], []).append(r["term"])
        vocab = spark.createDataFrame([(t,) for t in sorted({t for ts in got.values() for t in ts})], "term string")
        df = {r["term"]: r["df"] for r in bagged.select(F.explode("terms").alias("term"))
              .join(F.broadcast(vocab), "term").groupBy("term").agg(F.count("*").alias("df")).collect()}
        q = Queries(chunk, [sorted(got.get(i, [])) for i in chunk], df, N)
        seeds = work.save(_seeds(sketched, q), f"search_seeds_{start}")
        first = work.save(_rescored(bagged, seeds, q, N, L), f"search_first_{start}")
        tenth = {r["q"]: r["score"] for r in _top(first).filter(F.col("rank") == TOP).select("q", "score").collect()}
        threshold = np.array([float(tenth.get(j, 1)) for j in range(len(chunk))])
        rest = work.save(_candidates(sketched, q, threshold).join(keys.small(seeds), "block", "left_anti"), f"search_rest_{start}")
        scored = first.unionByName(work.save(_rescored(bagged, rest, q, N, L), f"search_scored_{start}"))
        ids = spark.createDataFrame([(j, i) for j, i in enumerate(chunk)], "q int, item_id long")
        results.append(_top(scored).join(F.broadcast(ids), "q").select(
            "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out
