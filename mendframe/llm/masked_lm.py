"""Document scores by masked pseudo-likelihood.

A model sees ``WINDOW`` words on both sides of a position and predicts the word
between them.  A document's score is the sum of the log-probabilities it gives
to every word: log P(class | window) + log P(word | class).

Words are put into a fixed number of classes: the most frequent words of the
whole corpus have one each, all others share classes by their look (case,
digits, symbols, length, ending).  P(class | window) is a small network over
the classes of both neighbours, times the association of the class with each
outer word of the window; the weights of the outer words (two numbers) are fitted
by a Newton step over every position.  Counts, network, weights and scores use the whole corpus.  Spark counts (left, middle, right) and
the pairs at each outer distance over all documents; the network is trained on
the counts in numpy, for a cost that doesn't depend on the corpus.

P(word | class) comes from the vocabulary: every word of the corpus with its
count, a written table that grows with the input.  The ``HEAD`` most frequent
words are looked up by the workers, all others are joined in Spark.  Half a
count is added to each word and to one unseen word of each class.

Defined cases: a null text or one without a word has no words, sum 0 and mean
null; repeated rows are counted and scored as often as they stand; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe.sources.workspace import Workspace

CLASSES = 128
#: Class 0 stands before the first and after the last word; then come the looks, then the frequent words.
LOOKS = 48
FREQUENT = CLASSES - 1 - LOOKS
SYMBOLS = frozenset("#*$%&|<>!@=+_/\\{}[]~^")
#: Words remembered by a worker; beyond that it starts afresh.
MEMORY = 500_000
#: Words seen on each side; those beyond the neighbours are the outer words.
WINDOW = 3
OUTER = range(2, WINDOW + 1)
#: Words whose probabilities the workers hold; the others are joined.
HEAD = 50_000
#: Counts that the association of an outer word must outweigh, and the weight from which the Newton step is taken.
SHRINK = 20
WEIGHT = 0.25
#: White space as Python's ``str.split()`` takes it (Java's ``\s`` with Unicode lacks U+001C to U+001F), so that
#: the vocabulary counted by Spark and the words coded by the workers are the same.
SPACE = "[\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
#: Positions that are scored at once: few enough for their rows of classes to stay in a core's cache.
CHUNK = 1024
#: Sums of outer terms below this leave float32 room for their exponentials.
ROOM = 60


def look(word: str) -> int:
    """Class 1 to LOOKS of a word that isn't frequent."""
    plain = word.isalpha()  # letters are neither symbols nor digits
    if not plain and not SYMBOLS.isdisjoint(word):
        kind = 0
    elif not plain and any(map(str.isdigit, word)):
        kind = 1
    elif len(word) > 1 and word.isupper():
        kind = 2
    elif not word[:1].islower():
        kind = 3 + (len(word) > 8)
    else:
        kind = 5 + zlib.crc32(word[-2:].encode()) % ((LOOKS - 5) // 2) * 2 + (len(word) > 8)
    return 1 + min(kind, LOOKS - 1)


class Classes(dict):
    """Class of each word, made when first asked for."""

    def __init__(self, frequent: list[str]):
        super().__init__()
        self.frequent = {w: 1 + LOOKS + i for i, w in enumerate(frequent)}

    def __missing__(self, word: str) -> int:
        if len(self) > MEMORY:
            self.clear()
        got = self[word] = self.frequent.get(word) or look(word)
        return got

    def of(self, text: str | None) -> np.ndarray:
        """Classes of a text's words with class 0 at both ends."""
        words = (text or "").split()
        return np.fromiter((0, *(self[w] for w in words), 0), np.int64, len(words) + 2)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of every word of all documents."""
    words = docs.select(F.explode(F.split("text", SPACE)).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def most_frequent(words: DataFrame, most: int) -> list[str]:
    """The ``most`` most frequent words of a vocabulary; ties go to the smaller word."""
    return [r["word"] for r in words.orderBy(F.desc("n"), "word").limit(most).collect()]


def frequent_words(docs: DataFrame, most: int = FREQUENT) -> list[str]:
    """The ``most`` most frequent words over all documents; ties go to the smaller word."""
    return most_frequent(vocabulary(docs), most)


def in_classes(words: DataFrame, frequent: list[str]) -> DataFrame:
    """(word, n, class) of a vocabulary."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(frequent)
        for batch in batches:
            got = pa.array([classes[w] for w in batch.column(0).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], ["word", "n", "class"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, class int")


def word_terms(classed: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """(word, n, logp) with log P(word | class) of words that share one, and that of an unseen word in each class."""
    shared = classed.where(F.col("class") <= LOOKS)
    total = {r["class"]: r["n"] + 0.5 * (r["types"] + 1) for r in
             shared.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect()}  # at most LOOKS rows
    table = F.array(*(F.lit(float(total.get(i, 0.5))) for i in range(LOOKS + 1)))
    return (shared.select("word", "n", F.log((F.col("n") + 0.5) / F.get(table, F.col("class"))).alias("logp")),
            {i: math.log(0.5 / total.get(i, 0.5)) for i in range(1, LOOKS + 1)})


def coded(docs: DataFrame, frequent: list[str], head: dict[str, float] | None = None, unseen: dict[int, float] | None = None) -> DataFrame:
    """(doc_id, classes, known, rest, unseen): a text's classes, one byte each.

    ``known`` is the sum of log P(word | class) over the words of ``head``; ``rest``
    lists the words that share a class and aren't in it, ``unseen`` their terms if the vocabulary doesn't have them.
    """
    sent = docs.sparkSession.sparkContext.broadcast((head, unseen))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, (terms, missing) = Classes(frequent), sent.value
        held = None if terms is None else terms | dict.fromkeys(frequent, 0.0)  # frequent words have a class of their own and no term
        for batch in batches:
            codes, known, rest, none = [], [], [], []
            look_up = classes.__getitem__
            for text in batch.column(1).to_pylist():
                words = (text or "").split()
                got = bytes(map(look_up, words))
                found, other = [], []
                if held is not None:  # known words add their term, others are listed
                    found = [*map(held.get, words)]
                    other = [i for i, t in enumerate(found) if t is None]
                codes.append(got)
                known.append(math.fsum(filter(None, found)))
                rest.append([words[i] for i in other])
                none.append([missing[got[i]] for i in other])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(codes, pa.binary()), pa.array(known, pa.float64()), pa.array(rest, pa.list_(pa.string())), pa.array(none, pa.list_(pa.float64()))],
                ["doc_id", "classes", "known", "rest", "unseen"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, classes binary, known double, rest array<string>, unseen array<double>")


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all texts in a row with WINDOW zeros around each, the places of their words, and each text's number of words."""
    gap = bytes(WINDOW)
    c = np.frombuffer(gap + gap.join(texts) + gap, np.uint8).astype(np.int64)
    return c, np.flatnonzero(c), np.fromiter(map(len, texts), np.int64, len(texts))


def counted(codes: DataFrame) -> DataFrame:
    """(kind, cell, n) over all texts.

    Kind 1: cell = (left * CLASSES + middle) * CLASSES + right.  Kind d of
    OUTER: class before * CLASSES + class d places after; one of both is a word.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {1: np.zeros(CLASSES ** 3, np.int64)} | {d: np.zeros(CLASSES ** 2, np.int64) for d in OUTER}
        for batch in batches:
            c, at, _ = laid_out(batch.column(0).to_pylist())
            values, n = np.unique((c[at - 1] * CLASSES + c[at]) * CLASSES + c[at + 1], return_counts=True)
            counts[1][values] += n
            for d in OUTER:
                pairs = c[:-d] * CLASSES + c[d:]
                counts[d] += np.bincount(pairs[pairs > 0], minlength=CLASSES ** 2)
        for kind, got in counts.items():
            seen = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), kind, np.int32)), pa.array(seen.astype(np.int32)), pa.array(got[seen])], ["kind", "cell", "n"])

    return codes.select("classes").mapInArrow(run, "kind int, cell int, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n"))


def cell_counts(docs: DataFrame, frequent: list[str]) -> DataFrame:
    """(cell, n) over all documents, cell = (left * CLASSES + middle) * CLASSES + right."""
    return counted(coded(docs, frequent)).where("kind = 1").select("cell", "n")


def train(counts: np.ndarray, width: int = 24, hidden: int = 48, rounds: int = 120, rate: float = 0.02, seed: int = 7) -> np.ndarray:
    """Log-probabilities [left, middle, right] of a network trained on the counts [left, middle, right].

    Vectors of both neighbours, a tanh layer, softmax over the classes; Adam on
    all contexts at once, each weighted by its count.
    """
    draw, v = np.random.default_rng(seed), len(counts)
    by_context = counts.transpose(0, 2, 1).reshape(v * v, v).astype(np.float32)
    weight = by_context.sum(axis=1)
    some = np.flatnonzero(weight)
    target, total = by_context[some], np.float32(max(1, weight.sum()))
    left, right = some // v, some % v
    # the look-ups are written as products with 0-1 matrices, which also gives their gradients
    shape = {"a": (v, width), "b": (v, width), "h": (2 * width, hidden), "hb": (hidden,), "o": (hidden, v), "ob": (v,)}
    p = {k: (draw.normal(0, 0.1, s) if len(s) == 2 else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
    p["ob"] += np.log(target.sum(axis=0) + 1).astype(np.float32)
    m, s = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    starts_l = np.searchsorted(left, np.arange(v))
    by_right = np.argsort(right, kind="stable")
    starts_r = np.searchsorted(right[by_right], np.arange(v))

    def summed(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        running = np.vstack([np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0, dtype=np.float64)])
        return (running[np.append(starts[1:], len(rows))] - running[starts]).astype(np.float32)

    def forward(ls: np.ndarray, rs: np.ndarray):
        x = np.hstack([p["a"][ls], p["b"][rs]])
        t = np.tanh(x @ p["h"] + p["hb"])
        z = t @ p["o"] + p["ob"]
        z -= z.max(axis=1, keepdims=True)
        return x, t, z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    for step in range(1, rounds + 1 if len(some) else 1):
        x, t, logp = forward(left, right)
        d = (np.exp(logp) * weight[some][:, None] - target) / total
        g = {"o": t.T @ d, "ob": d.sum(axis=0)}
        d = (d @ p["o"].T) * (1 - t * t)
        g |= {"h": x.T @ d, "hb": d.sum(axis=0)}
        d = d @ p["h"].T
        g |= {"a": summed(d[:, :width], starts_l), "b": summed(d[by_right, width:], starts_r)}
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
            p[k] -= np.float32(rate) * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.99 ** step)) + 1e-8)
    out = np.empty((v, v, v), np.float32)
    every = np.arange(v)
    for one in range(v):
        out[one] = forward(np.full(v, one), every)[2].T
    return out


def associations(pairs: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """log P(middle | outer) / P(middle) [outer, middle] for each place -d and d, from counts [before, after] at each distance."""
    out = {}
    for d, counts in pairs.items():
        for place, n in ((-d, counts), (d, counts.T)):
            n = n.astype(np.float64)
            n[:, 0] = 0  # the middle is a word
            alone = (n.sum(axis=0) + 0.5) / (n.sum() + 0.5 * CLASSES)
            out[place] = np.log((n + SHRINK * alone) / (n.sum(axis=1, keepdims=True) + SHRINK) / alone).astype(np.float32)
    return out


def fitted(codes: DataFrame, table: np.ndarray, outer: dict[int, np.ndarray]) -> dict[int, float]:
    """Weight of each distance: a Newton step on the log-likelihood of all positions, from WEIGHT."""
    scaled = {d: np.float32(WEIGHT) * x for d, x in outer.items()}
    sent = codes.sparkSession.sparkContext.broadcast((np.ascontiguousarray(table.transpose(0, 2, 1)).reshape(-1, CLASSES), scaled))
    k = len(OUTER)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, tables = np.exp(sent.value[0]), sent.value[1]
        slope, bend, ones = np.zeros(k), np.zeros((k, k)), np.ones(CLASSES, np.float32)
        for batch in batches:
            c, every, _ = laid_out(batch.column(0).to_pylist())
            for i in range(0, len(every), CHUNK):
                at = every[i:i + CHUNK]
                own, rows = c[at], np.arange(len(at))
                f = [tables[-d].take(c[at - d], axis=0) + tables[d].take(c[at + d], axis=0) for d in OUTER]
                p = np.exp(reduce(np.add, f))
                p *= base.take(c[at - 1] * CLASSES + c[at + 1], axis=0)
                p /= (p @ ones)[:, None]
                weighed = [p * x for x in f]
                mean = [(w @ ones).astype(np.float64) for w in weighed]
                for j in range(k):
                    slope[j] += f[j][rows, own].sum(dtype=np.float64) - mean[j].sum()
                    for m in range(j, k):
                        bend[j, m] += np.vdot(weighed[j], f[m]) - mean[j] @ mean[m]
        yield pa.RecordBatch.from_arrays([pa.array([*range(k * (k + 1))], pa.int32()), pa.array([*slope, *bend.ravel()], pa.float64())], ["i", "x"])

    got = {r["i"]: r["x"] for r in codes.select("classes").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()}
    sums = np.array([got.get(i, 0.0) for i in range(k * (k + 1))])
    slope, bend = sums[:k] / WEIGHT, sums[k:].reshape(k, k) / WEIGHT ** 2  # the terms were taken WEIGHT times
    step = np.linalg.solve(bend + np.triu(bend, 1).T + 1e-3 * np.eye(k), slope)
    return {d: float(w) for d, w in zip(OUTER, np.clip(WEIGHT + step, 0, 1), strict=True)}


def class_terms(codes: DataFrame, table: np.ndarray, outer: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(columns of ``codes``, n_words, class_logprob): the sum of log P(class | window) of each text; ``outer`` is weighted."""
    base = np.ascontiguousarray(table.transpose(0, 2, 1)).reshape(-1, CLASSES)
    sent = codes.sparkSession.sparkContext.broadcast((base, outer))
    place = codes.columns.index("classes")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.drop("classes").schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, tables = sent.value
        ones = np.ones(CLASSES, np.float32)
        tight = sum(float(np.abs(x).max()) for x in (tables or {}).values()) > ROOM
        for batch in batches:
            c, every, n = laid_out(batch.column(place).to_pylist())
            logp = np.empty(len(every))
            for i in range(0, len(every), CHUNK):
                at = every[i:i + CHUNK]
                cell = c[at - 1] * CLASSES + c[at + 1]
                if not tables:
                    logp[i:i + CHUNK] = base[cell, c[at]]
                    continue
                z = base.take(cell, axis=0)
                for d, x in tables.items():
                    z += x.take(c[at + d], axis=0)
                own = z[np.arange(len(at)), c[at]]
                if tight:
                    most = z.max(axis=1)
                    z -= most[:, None]
                    own -= most
                logp[i:i + CHUNK] = own - np.log(np.exp(z, out=z) @ ones)
            sums = np.bincount(np.repeat(np.arange(len(n)), n), logp, len(n)) if len(n) else np.zeros(0)
            others = [x for i, x in enumerate(batch.columns) if i != place]
            yield pa.RecordBatch.from_arrays([*others, pa.array(n, pa.int64()), pa.array(sums, pa.float64())],
                                             [*(x for x in batch.schema.names if x != "classes"), "n_words", "class_logprob"])

    return codes.mapInArrow(run, f"{schema}, n_words long, class_logprob double")


def _scores(rows: DataFrame, total) -> DataFrame:
    return rows.select("doc_id", "n_words", total.alias("sum_logprob"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_logprob"))


def score(docs: DataFrame, frequent: list[str], table: np.ndarray) -> DataFrame:
    """(doc_id, n_words, sum_logprob, mean_logprob) of every document, by the classes of words and neighbours alone."""
    return _scores(class_terms(coded(docs, frequent).select("doc_id", "classes"), table), F.col("class_logprob"))


def learn_and_score(docs: DataFrame, work: Workspace) -> DataFrame:
    """Train on all documents and score all of them."""
    words = work.save(vocabulary(docs), "vocabulary")
    frequent = most_frequent(words, FREQUENT)
    terms, unseen = word_terms(work.save(in_classes(words, frequent), "classed"))
    head = {r["word"]: r["logp"] for r in terms.orderBy(F.desc("n"), "word").limit(HEAD).collect()}
    codes = coded(docs, frequent, head, unseen).withColumn("key", F.monotonically_increasing_id())
    codes = work.save(codes, "coded")  # keys stay as they are
    counts, pairs = np.zeros(CLASSES ** 3, np.float32), {d: np.zeros(CLASSES ** 2) for d in OUTER}
    for r in work.save(counted(codes), "cells").toLocalIterator(prefetchPartitions=True):  # at most CLASSES ** 3 rows, and CLASSES ** 2 of each distance
        (counts if r["kind"] == 1 else pairs[r["kind"]])[r["cell"]] = r["n"]
    table = train(counts.reshape(CLASSES, CLASSES, CLASSES))
    outer = associations({d: n.reshape(CLASSES, CLASSES) for d, n in pairs.items()})
    weight = fitted(codes, table, outer)
    by_class = class_terms(codes.select("key", "doc_id", "known", "classes"), table, {d: np.float32(weight[abs(d)]) * x for d, x in outer.items()})
    rest = codes.select("key", F.explode(F.arrays_zip("rest", "unseen")).alias("x")).select("key", F.col("x.rest").alias("word"), F.col("x.unseen").alias("unseen"))
    joined = rest.join(terms.select("word", "logp"), "word", "left")
    by_word = joined.groupBy("key").agg(F.sum(F.coalesce("logp", "unseen")).alias("by_word"))
    rows = by_class.join(by_word, "key", "left")
    return _scores(rows, F.col("class_logprob") + F.col("known") + F.coalesce("by_word", F.lit(0.0)))
