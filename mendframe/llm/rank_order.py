"""Language identification by rank-order profiles of character n-grams.

A language's profile is the ranked list of its most frequent n-grams over all
training documents.  A document's own ranked list is held against each
profile: the distance is the sum over its n-grams of how far out of place they
are, an unknown n-gram counting as the largest displacement.

n-grams have 1 to 3 characters of the lower-cased text in which every run of
non-letters is one blank; ties in frequency go to the smaller n-gram (shorter
ones last characters first compared by code point), ties between languages to
the smaller name.

Defined cases: a null text or one without a letter is ``und`` with score 0;
without training documents everything is ``und``; a null doc_id is neither
learned from nor held out; a null lang is not learned from; repeated rows count
as often as they stand; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PROFILE = 400
UNKNOWN = "und"
BLANK = 32
#: A batch's n-grams are counted in pieces of so many characters, which bounds a worker's memory.
CHUNK = 2_000_000

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter, once for each worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def code_points(text: str) -> np.ndarray:
    """Lower-cased letters, with one blank for each run of anything else and at both ends; empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    is_letter = letters()[points]
    if not is_letter.any():
        return np.empty(0, np.int64)
    points = np.where(is_letter, points, BLANK)
    points = points[is_letter | np.append(True, is_letter[:-1])]
    points = np.concatenate(([BLANK] if points[0] != BLANK else [], points, [BLANK] if points[-1] != BLANK else []))
    return points.astype(np.int64)


def grams(points: np.ndarray) -> np.ndarray:
    """All n-grams as numbers of 21 bits for each character; lone blanks are none."""
    two = points[:-1] << 21 | points[1:]
    three = two[:-1] << 21 | points[2:]
    return np.concatenate((points[points != BLANK], two, three))


def ranked(values: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` most frequent n-grams, most frequent first."""
    if len(values) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        values, counts = values[counts >= least], counts[counts >= least]
    return values[np.lexsort((values, -counts))][:most]


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) partial counts of (lang, text); one row for each n-gram of a language in a batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(lang: str, parts: list[np.ndarray]) -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(n)], ["lang", "gram", "n"])

        for batch in batches:
            waiting: dict[str, list[np.ndarray]] = {}
            size: dict[str, int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                points = code_points(text)
                if len(points):
                    waiting.setdefault(lang, []).append(grams(points))
                    size[lang] = size.get(lang, 0) + len(points)
                    if size[lang] > CHUNK:
                        yield counted(lang, waiting.pop(lang))
                        del size[lang]
            for lang, parts in waiting.items():
                yield counted(lang, parts)

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")


def profiles(docs: DataFrame, most: int = PROFILE) -> dict[str, np.ndarray]:
    """Each language's ranked n-grams, ``most`` at most, over all rows of (lang, text)."""
    counts = gram_counts(docs.where("lang IS NOT NULL AND text IS NOT NULL")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    out: dict[str, list] = {}
    for r in top.select("lang", "gram", "rank").collect():  # ``most`` rows a language
        out.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return {lang: np.array([g for _, g in sorted(x)], np.int64) for lang, x in sorted(out.items())}


def distances(own: np.ndarray, known: np.ndarray, place: np.ndarray, most: int) -> np.ndarray:
    """Out-of-place distance to each language: ``place[k, i]`` is the rank of n-gram ``known[k]`` in profile i, -1 if absent."""
    at = np.searchsorted(known, own)
    at[at == len(known)] = 0
    there = place[at]
    there[known[at] != own] = -1
    apart = np.abs(there - np.arange(len(own))[:, None])
    return np.where(there < 0, most, apart).sum(axis=0)


def identify(docs: DataFrame, model: dict[str, np.ndarray], most: int = PROFILE) -> DataFrame:
    """``docs`` (any columns, with text) with lang_pred and score.

    The score is the lead over the runner-up as a share of the runner-up's
    distance; with a single language it is the share of the largest distance
    that is left.
    """
    langs = sorted(model)
    known = np.unique(np.concatenate([np.empty(0, np.int64), *(model[k] for k in langs)]))
    place = np.full((len(known), len(langs)), -1, np.int64)
    for i, lang in enumerate(langs):
        place[np.searchsorted(known, model[lang]), i] = np.arange(len(model[lang]))
    kept = [c for c in docs.columns if c != "text"]

    def predict(text: str | None) -> tuple[str, float]:
        points = code_points(text or "")
        if not len(points) or not langs:
            return UNKNOWN, 0.0
        own = ranked(*np.unique(grams(points), return_counts=True), most)
        away = distances(own, known, place, most)
        best = int(away.argmin())
        rest = int(np.delete(away, best).min()) if len(langs) > 1 else most * len(own)
        return langs[best], float((rest - away[best]) / rest) if rest else 0.0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())],
                [*kept, "lang_pred", "score"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{fields}lang_pred string, score double")


def held_out(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, text, held_out): a quarter of the documents, by checksum of the id, is never learned from."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    return docs.select(F.col("doc_id"), F.col("lang"), F.col("text"), F.coalesce(fold == 2, F.lit(False)).alias("held_out"))


def learn_and_identify(docs: DataFrame, most: int = PROFILE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, by profiles of those not held out."""
    rows = held_out(docs)
    model = profiles(rows.where(~F.col("held_out") & F.col("doc_id").isNotNull()), most)
    return identify(rows.select("doc_id", "held_out", "text"), model, most)
