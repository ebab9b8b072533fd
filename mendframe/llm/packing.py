"""Packing by minimum bin slack.

Documents become pieces of at most ``size`` tokens.  Pieces of one length are
alike, so the packing problem is its histogram: at most ``size`` numbers,
however many documents there are.  The driver plans on the histogram: it fixes
the longest piece left, finds by a bitset subset sum the fullest bin that
holds it, and removes that combination as often as the counts allow.  Every
removal uses up a length, so the plan stays small.  Spark then numbers the
pieces of each length and looks their places up in the plan.

Defined cases: a null or empty text is the end token alone; rows with equal
doc_id and text are packed one by one; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mendframe.sources.workspace import Workspace

SIZE = 2048
END = 0
#: Sub-groups of a length in which its pieces are numbered, so that a length that most pieces have isn't one task.
SALTS = 64
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def default_vocabulary() -> str:
    """Ranks of the public 50k byte-level vocabulary; its ids are those of ``byte_bpe_50k.json``."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_added() -> str:
    """The tokenizer file whose added tokens (``<|endoftext|>`` = 50256) are matched in texts, as that library does."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_encodings: dict = {}


def encoding(path: str, added: str | None = None):
    """The vocabulary's encoder, once for each worker, with the added tokens of the tokenizer file ``added``.

    Encode with ``allowed_special="all"``: an added token's string in a text
    is that token, as the tokenizer file's own library gives it without flags.
    """
    key = (path, added)
    if key not in _encodings:
        import json

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        special = {}
        if added:
            with open(added) as f:
                special = {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}
        _encodings[key] = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                            special_tokens=special)
    return _encodings[key]


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: whole ones, and before them what is over."""
    if n <= size:
        return [(0, n)]
    first = n % size
    return ([(0, first)] if first else []) + [(at, size) for at in range(first, n, size)]


def pieces(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, end: int = END, keep_ids: bool = False,
           added: str | None = None) -> DataFrame:
    """One row for each piece; ``ids`` (array of int) only if asked for."""
    path = vocabulary or default_vocabulary()
    extra = added if added is not None else (default_added() if vocabulary is None else None)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(path, extra)

        def encode(text: str) -> list[int]:
            return coder.encode(text, allowed_special="all")
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids)}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "")
                ids.append(end)
                data = np.asarray(ids, dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), size)):
                    out["doc_id"].append(doc)
                    out["piece"].append(k)
                    out["start"].append(start)
                    out["length"].append(length)
                    out["ids_crc32"].append(zlib.crc32(data[start:start + length].tobytes()))
                    if keep_ids:
                        out["ids"].append(ids[start:start + length])
            types = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int32(),
                     "ids_crc32": pa.int64(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([pa.array(v, types[k]) for k, v in out.items()], list(out))

    schema = PIECES + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def fullest(counts: dict[int, int], size: int) -> dict[int, int]:
    """The combination with the largest sum up to ``size`` that holds the longest length; length -> how often.

    Bit s of ``reach[k]`` says that the first k lots can sum to s.  A length
    with several pieces gives lots of 1, 2, 4, ... of them.
    """
    longest = max(counts)
    room = size - longest
    mask = (1 << (room + 1)) - 1
    lots: list[tuple[int, int]] = []
    reach = [1]
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == longest), room // length)
        lot = 1
        while left > 0:
            n = min(lot, left)
            now = (reach[-1] | reach[-1] << (n * length)) & mask
            if now != reach[-1]:
                lots.append((length, n))
                reach.append(now)
            left -= n
            lot *= 2
        if reach[-1] >> room & 1:
            break
    total = reach[-1].bit_length() - 1
    chosen = {longest: 1}
    for k in range(len(lots) - 1, -1, -1):
        if not reach[k] >> total & 1:
            length, n = lots[k]
            chosen[length] = chosen.get(length, 0) + n
            total -= n * length
    return chosen


@dataclass
class Plan:
    """For each length: from which number on its pieces go where; sorted by that number."""

    first: dict[int, list[int]] = field(default_factory=dict)
    each: dict[int, list[int]] = field(default_factory=dict)
    bin: dict[int, list[int]] = field(default_factory=dict)
    offset: dict[int, list[int]] = field(default_factory=dict)
    bins: int = 0

    def arrays(self) -> dict[int, tuple[np.ndarray, ...]]:
        return {k: tuple(np.array(x[k], dtype=np.int64) for x in (self.first, self.each, self.bin, self.offset)) for k in self.first}


def plan(histogram: dict[int, int], size: int = SIZE) -> Plan:
    """Where the pieces of each length go.  At most one combination for each length that is used up."""
    left, used, out = {k: n for k, n in histogram.items() if n > 0}, dict.fromkeys(histogram, 0), Plan()
    while left:
        chosen = fullest(left, size)
        times = min(left[k] // n for k, n in chosen.items())
        offset = 0
        for length, n in sorted(chosen.items(), reverse=True):
            for part, value in ((out.first, used[length]), (out.each, n), (out.bin, out.bins), (out.offset, offset)):
                part.setdefault(length, []).append(value)
            used[length] += n * times
            offset += n * length
            left[length] -= n * times
            if not left[length]:
                del left[length]
        out.bins += times
    return out


def place(rows: DataFrame, size: int, work: Workspace) -> DataFrame:
    """``rows`` (saved pieces) with sequence_id and offset."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    counts = work.save(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "length_counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    where = rows.sparkSession.sparkContext.broadcast(plan(histogram, size).arrays())
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = (salted.withColumn("nth", F.row_number().over(within) - 1)
                .join(F.broadcast(starts), ["length", "salt"])  # at most size * SALTS rows
                .withColumn("nth", F.col("first") + F.col("nth")).drop("first", "salt"))

    def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = where.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            nth = batch.column("nth").to_numpy(zero_copy_only=False).astype(np.int64)
            sequence, offset = np.zeros(len(nth), np.int64), np.zeros(len(nth), np.int64)
            for value in np.unique(length):
                at = np.flatnonzero(length == value)
                first, each, bins, offsets = table[int(value)]
                k = np.searchsorted(first, nth[at], side="right") - 1
                inner = nth[at] - first[k]
                sequence[at] = bins[k] + inner // each[k]
                offset[at] = offsets[k] + inner % each[k] * value
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    kept = rows.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return numbered.select(*kept, "nth").mapInArrow(look_up, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, work: Workspace, size: int = SIZE, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    return place(work.save(pieces(docs, size, vocabulary, keep_ids=keep_ids), "pieces"), size, work)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of every sequence, from ``pack(..., keep_ids=True)``.  A group holds at most ``size`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
