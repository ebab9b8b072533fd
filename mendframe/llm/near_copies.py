"""Near copies by fast similarity sketching.

A document is the set of its word shingles.  The sketch has COORDINATES
places.  In round i every shingle is thrown into one place with a value
i + fraction, both from a hash of (i, shingle); a place keeps its smallest
value.  After COORDINATES rounds, round COORDINATES + j throws everything into place
j, so every place is filled; small sets are done when all are, large ones
after a round or two.  Two sketches agree in a place with the probability of
the sets' similarity, and the number of agreements is concentrated around it.

Documents with one set are one node.  Places are banded; nodes that share a
band are candidates, and a candidate pair is a link if the full sets say so.
Only components are wanted, so no group is expanded into pairs:

1. In each bucket the node with the most company in all its bands is the
   middle.  Each node is checked against one middle of its bands, and
   components of those links are found; then against a few other nodes drawn from
   its buckets that aren't in its component yet.
2. Where a bucket still holds several components, shingles are counted over
   its nodes.  Shingles that only one of them has can't be shared: a node with more than a fifth of
   them has no further link, and for others they bound the
   similarity of each pair.  Pairs across components within the bound are
   checked: in small buckets by a join; large ones are cut into blocks, and each
   pair of blocks is a task that works in numpy.  Left out are pairs that differ too much
   in the counts of their shingles over CELLS cells, which is exact, and pairs whose sketches
   agree in too few places (five standard deviations below the threshold).

Bands of 5 places, 40 of them: a pair of similarity 0.8 shares none with
probability 1.3e-7; that and the five deviations are the only chances to miss a
link.  Shingles and sets are compared by 64- and 128-bit hashes.

Defined cases: a null text or one without words has an empty set, links with
nothing and is its own component; rows with equal sets are linked, so repeated rows
are; rows without doc_id take the component of their set (null if no member
has one) and are kept only then; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe.sources.workspace import Workspace

from .components import components
from .keys import small, text_key

COORDINATES = 200
ROWS = 5
BANDS = COORDINATES // ROWS
THRESHOLD = 80  # per cent
STARS = 2
#: Middles of other components that a node is checked against in each further round.
TRIES = 4
#: Agreeing places below which a pair isn't looked at: five standard deviations under the threshold.
LEAST_AGREEING = int(0.8 * COORDINATES - 5 * (COORDINATES * 0.8 * 0.2) ** 0.5)
#: Cells over which shingles are counted, to bound how far two sets are apart.
CELLS = 256
#: Larger buckets are compared in blocks of so many nodes.
BLOCK = 256
#: Documents sketched together, and words remembered by a worker.
TOGETHER = 128
MEMORY = 500_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _S16 = (np.uint64(x) for x in (30, 27, 31, 16))
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers (the finishing steps of a public generator)."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


class Shingles:
    """Sets of hashed word shingles; words are lower-cased in A-Z and end at blanks, tabs, line and page breaks."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def of(self, text: str | None) -> np.ndarray:
        known, tokens = self.known, (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not tokens:
            return np.empty(0, np.uint64)
        if len(known) > MEMORY:
            known.clear()
        for w in tokens:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter((known[w] for w in tokens), np.uint64, len(tokens))
        k = min(self.words, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = mixed(out + h[i:len(h) - k + 1 + i])
        return np.unique(out)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of COORDINATES numbers for each (not empty) set."""
    t = COORDINATES
    out = np.full((len(sets), t), EMPTY, np.uint64)
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for i in range(2 * t):
        h = mixed(items ^ mixed(np.full(1, i + 1, np.uint64)))
        place = (h % np.uint64(t)).astype(np.int64) if i < t else np.full(len(h), i - t)
        np.minimum.at(out.reshape(-1), owner * t + place, (np.uint64(i) << np.uint64(48)) | (h >> _S16))
        open_ = (out == EMPTY).any(axis=1)
        if not open_.any():
            break
        still = open_[owner]
        items, owner = items[still], owner[still]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    rows = sketch.reshape(len(sketch), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sketch), BANDS)).copy()
    for r in range(ROWS):
        key = mixed(key + rows[:, :, r])
    return key.view(np.int64)


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, key, n_shingles, node, bands, sketch); node, bands and sketch are null for empty sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                part = batch.slice(at, TOGETHER)
                sets = [shingles.of(t) for t in part.column(2).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                node, bands, small = ([None] * len(sets) for _ in range(3))
                if full:
                    sk = sketches([sets[i] for i in full])
                    keys, short = band_keys(sk), (mixed(sk) & np.uint64(0xFF)).astype(np.uint8)
                    for j, i in enumerate(full):
                        node[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                        bands[i], small[i] = keys[j], short[j].tobytes() + cell_counts(sets[i])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.binary()),
                     pa.array(bands, pa.list_(pa.int64())), pa.array(small, pa.binary())],
                    ["doc_id", "key", "n_shingles", "node", "bands", "sketch"])

    return docs.select("doc_id", "key", "text").mapInArrow(
        run, "doc_id long, key binary, n_shingles long, node binary, bands array<long>, sketch binary")


def cell_counts(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each of CELLS cells, 255 at most."""
    return np.minimum(np.bincount((shingles % np.uint64(CELLS)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes()


def unpacked(sketches_: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches_), np.uint8).reshape(-1, COORDINATES + CELLS)


def may_link(x: np.ndarray, y: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Whether unpacked rows may be similar enough; ``both`` is the sum of the set sizes.

    Sets differ in at least as many shingles as their cells differ in counts.
    """
    apart = np.abs(x[:, COORDINATES:].astype(np.int16) - y[:, COORDINATES:]).sum(axis=1)
    agree = (x[:, :COORDINATES] == y[:, :COORDINATES]).sum(axis=1)
    return (100 * (both - apart) >= THRESHOLD * (both + apart)) & (agree >= LEAST_AGREEING)


def alike(pairs: DataFrame) -> DataFrame:
    """(a, b) of the pairs (a, b, sketch_a, sketch_b, both) that may be similar enough."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y = (unpacked(batch.column(c).to_pylist()) for c in ("sketch_a", "sketch_b"))
                yes = may_link(x, y, batch.column("both").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(yes))

    return pairs.select("a", "b", "sketch_a", "sketch_b", F.col("both").cast("long").alias("both")).mapInArrow(run, "a long, b long")


def alike_in_blocks(members: DataFrame) -> DataFrame:
    """(a, b) across components within large buckets: members (band, id, root, n, n_shingles, own, sketch)."""
    cut = members.withColumn("n", F.ceil(F.col("n") / BLOCK)).withColumn("part", F.pmod(F.xxhash64("id"), "n"))
    others = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    dealt = cut.withColumn("other", F.explode(others)).select(
        "band", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "id", "root", "n_shingles", "own", "sketch",
        (F.col("part") <= F.col("other")).alias("first"))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        sk = unpacked(part["sketch"])
        number, root, size, own, first = (part[c].to_numpy() for c in ("id", "root", "n_shingles", "own", "first"))
        same = bool((part["i"] == part["j"]).all())
        out = []
        for k in np.flatnonzero(first):
            common = np.minimum(size - own, size[k] - own[k])
            yes = (root != root[k]) & (100 * common >= THRESHOLD * (size + size[k] - common))
            yes &= (np.arange(len(sk)) > k) if same else ~first
            at = np.flatnonzero(yes)
            at = at[may_link(sk[at], sk[k:k + 1], size[at] + size[k])]
            out.append(np.column_stack([np.minimum(number[at], number[k]), np.maximum(number[at], number[k])]))
        return pd.DataFrame(np.concatenate(out) if out else np.empty((0, 2), np.int64), columns=["a", "b"])

    return dealt.groupBy("band", "i", "j").applyInPandas(compare, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; texts (id, text) has one text for each node."""
    one = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = one.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, last, known = Shingles(words), None, None
        for batch in batches:
            yes, a, text_a, text_b = [], *(batch.column(c) for c in ("a", "text_a", "text_b"))
            for i in range(len(batch)):
                if a[i].as_py() != last:  # a star's links mostly follow each other
                    last, known = a[i].as_py(), shingles.of(text_a[i].as_py())
                s = shingles.of(text_b[i].as_py())
                common = len(np.intersect1d(known, s, assume_unique=True))
                yes.append(100 * common >= THRESHOLD * (len(known) + len(s) - common))
            yield pa.RecordBatch.from_arrays([a, batch.column("b")], ["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def texts_of(ids: DataFrame, docs: DataFrame, nodes: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(id, text) of the nodes with the given ids, one text for each."""
    used = work.save(nodes.select("id", "key").join(ids, "id", "left_semi"), f"{name}_nodes")
    return docs.join(small(used), "key").select("id", "text").dropDuplicates(["id"])


def own_shingles(ids: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, work: Workspace) -> DataFrame:
    """(id, own): how many shingles of each node no other of these nodes has; 0 where the node is missing."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in batches:
            ids_, texts = batch.column(0), batch.column(1)
            for i in range(len(batch)):
                s = shingles.of(texts[i].as_py()).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), ids_[i].as_py(), np.int64)), pa.array(s)], ["id", "s"])

    each = texts_of(ids, docs, nodes, work, "own").mapInArrow(run, "id long, s long")
    once = each.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1")
    return work.save(once.groupBy("id").agg(F.count(F.lit(1)).alias("own")), "own_shingles")


def checked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, work: Workspace, name: str) -> DataFrame:
    """Confirm written pairs (a, b); only the texts of nodes in a pair are moved, one for each node."""
    used = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    texts = work.save(texts_of(used, docs, nodes, work, name), f"{name}_texts")
    links = work.save(confirmed(pairs, texts, words), f"{name}_links")
    work.drop(f"{name}_texts")
    return links


def _renamed(roots: DataFrame, node: str, root: str) -> DataFrame:
    return roots.select(F.col("node").alias(node), F.col("root").alias(root))


def components_of(docs: DataFrame, words: int, work: Workspace) -> DataFrame:
    """(doc_id, key, root, n_shingles, component_id, kept) of every row of ``docs``.

    ``key`` is a hash of the text, ``root`` the component's own name, null for empty sets.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("key"), "text")
    sets = work.save(sketched(docs, words), "sets")
    each = sets.where("node IS NOT NULL").select("node", "key", "n_shingles", "bands", "sketch").dropDuplicates(["node"])
    # from here on nodes have short numbers; they are fixed by being written
    nodes = work.save(each.withColumn("id", F.monotonically_increasing_id()), "nodes")
    entries = nodes.select("id", F.explode("bands").alias("band"))
    buckets = work.save(entries.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = work.save(entries.join(buckets, "band"), "bucket_members")
    # a node with much company in its bands is in the middle of its group
    weights = work.save(members.groupBy("id").agg((-F.sum("n")).alias("order")), "weights")

    links = roots = tried = None
    for step in range(STARS):
        ranked = members.join(weights, "id") if step == 0 else members.withColumn("order", F.xxhash64("id", F.lit(step)))
        middles = work.save(ranked.groupBy("band").agg(F.min(F.struct("order", "id")).alias("first")), f"middles{step}")
        apart = members.join(middles, "band").select("id", "band", "first", F.col("first.id").alias("middle")).where("id <> middle")
        if roots is not None:
            apart = apart.join(_renamed(roots, "id", "r1"), "id", "left").join(_renamed(roots, "middle", "r2"), "middle", "left").where(
                "coalesce(r1, id) <> coalesce(r2, middle)").join(tried.select(F.col("a").alias("middle"), F.col("b").alias("id")), ["middle", "id"], "left_anti")
        part = F.pmod(F.xxhash64("band"), F.lit(1 if step == 0 else TRIES))
        pairs = apart.groupBy("id", part.alias("part")).agg(F.min("first").alias("first"))
        pairs = work.save(pairs.select(F.col("first.id").alias("a"), F.col("id").alias("b")).distinct(), f"star{step}_pairs")
        if pairs.isEmpty():
            break
        more = checked(pairs, docs, nodes, words, work, f"star{step}")
        links, tried = (x if y is None else y.unionByName(x) for x, y in ((more, links), (pairs, tried)))
        roots = components(links, work, f"cc{step}")

    # buckets that still hold several components
    if roots is not None:
        rooted = work.save(members.join(_renamed(roots, "id", "root"), "id", "left").select(
            "band", "id", "n", F.coalesce("root", "id").alias("root")), "rooted_members")
        still = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("n").alias("n"))
        still = work.save(still.where("low <> high").select("band", "n"), "open")
        work.drop("bucket_members")
        parts = work.save(rooted.join(still.select("band"), "band", "left_semi").select("band", "id", "root"), "open_members")
        own = own_shingles(parts.select("id").distinct(), docs, nodes, words, work)
        fit = nodes.select("id", "n_shingles").join(parts.select("id").distinct(), "id", "left_semi").join(own, "id", "left").withColumn(
            "own", F.coalesce("own", F.lit(0)))
        fit = work.save(fit.where(f"100 * own <= {100 - THRESHOLD} * n_shingles"), "fit")
        parts = work.save(parts.join(fit, "id"), "candidates")
        left = parts.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"))
        parts = work.save(parts.join(work.save(left.where("low <> high").select("band", "n"), "left"), "band"), "left_members")
        parts = work.save(parts.join(nodes.select("id", "sketch"), "id"), "parts")
        few = parts.where(F.col("n") <= BLOCK)
        other = few.select("band", *(F.col(c).alias(f"{c}_b") for c in ("id", "root", "n_shingles", "own", "sketch")))
        common = "least(n_shingles - own, n_shingles_b - own_b)"
        across = few.join(other, "band").where(
            f"id < id_b AND root <> root_b AND 100 * {common} >= {THRESHOLD} * (n_shingles + n_shingles_b - {common})")
        across = alike(across.select(F.col("id").alias("a"), F.col("id_b").alias("b"), F.col("sketch").alias("sketch_a"), "sketch_b",
                                     (F.col("n_shingles") + F.col("n_shingles_b")).alias("both")))
        many = alike_in_blocks(parts.where(F.col("n") > BLOCK))
        done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = work.save(across.unionByName(many).distinct().join(done, ["a", "b"], "left_anti"), "across_pairs")
        if not pairs.isEmpty():
            links = links.unionByName(checked(pairs, docs, nodes, words, work, "across"))
            roots = components(links, work, "cc_all")

    names = nodes.select("id", "node")
    if roots is None:
        names = names.select("node", F.col("id").alias("root"))
    else:
        names = names.join(_renamed(roots, "id", "root"), "id", "left").select("node", F.coalesce("root", "id").alias("root"))
    names = work.save(names, "names")
    rooted = work.save(sets.select("doc_id", "key", "n_shingles", "node").join(names, "node", "left").drop("node"), "rooted")
    for done in ("sets", "nodes", "buckets", "bucket_members", "rooted_members", "open_members", "candidates", "left_members", "parts", "names"):
        work.drop(done)
    least = work.save(rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("low")), "least")
    out = rooted.join(least, "root", "left").select(
        "doc_id", "key", "root", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_copies(docs: DataFrame, words: int, work: Workspace) -> DataFrame:
    """The rows of ``docs`` with one row of each component left; rows with empty sets stay."""
    found = work.save(components_of(docs, words, work), "near_copies")
    gone = work.save(found.where("NOT kept").select(F.col("doc_id").alias("_gone_id"), F.col("key").alias("_gone_key")).distinct(), "gone")
    keyed = docs.withColumns({"_mf_id": F.col("doc_id").cast("long"), "_mf_key": text_key("text")})
    left = keyed.join(small(gone), F.col("_mf_id").eqNullSafe(F.col("_gone_id")) & (F.col("_mf_key") == F.col("_gone_key")), "left_anti")
    several = found.where("kept AND root IS NOT NULL").groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("_one"))
    several = work.save(several.where("n > 1").drop("n"), "several")
    if not several.isEmpty():  # rows repeated with their doc_id, or several rows without one
        spare = found.where("kept").join(several, "root")
        spare = work.save(spare.select(F.col("doc_id").alias("_again_id"), F.col("key").alias("_again_key"), (F.col("key") == F.col("_one")).alias("_stays")).distinct(), "spare")
        marked = left.join(small(spare), F.col("_mf_id").eqNullSafe(F.col("_again_id")) & (F.col("_mf_key") == F.col("_again_key")), "left")
        left = marked.where("_stays IS NULL").unionByName(marked.where("_stays").dropDuplicates(["_mf_id", "_mf_key"]))
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))
