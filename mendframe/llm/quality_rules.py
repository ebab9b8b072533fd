"""Quality rules as a learned decision list (native).

Sequential covering: a rule is a conjunction of thresholds on document
statistics.  It is grown condition by condition on two thirds of the labelled
documents (FOIL gain), cut back on the other third, and kept while it is
precise there; the documents it covers are set aside and the next rule is
learned.  The list becomes one Spark conditional expression.

Each step reads counts of (feature, bin, label) from a Spark aggregate over all
labelled documents, so training has no bound on their number; the driver sees
some hundred counts.

Defined cases: a null text has no words and fails the base rules; documents
without a label, with a null label or a null doc_id are judged but not
learned from; several labels of one document all count; without labels there
is no rule and the base rules decide; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe.functions.text import let
from mendframe.sources.workspace import Workspace

from .keys import small, text_key

#: A word is a run of anything but blank, tab, line and page breaks.
WORD = r"[^\x20\x09-\x0D]++"
SYMBOL = r"[#*$%&|<>]+"
WINDOW = 5
MIN_WORDS = 10
MOST_REPEATED = 20

QUANTILES = [0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.93, 0.96, 0.98, 0.99, 0.995, 0.998]
MOST_RULES = 8
MOST_CONDITIONS = 3
LEAST_PRECISION = 0.9
LEAST_SUPPORT = 3

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics that rules may use, from those of ``measured``.
FEATURES = {
    "n_words": "n_words",
    "word_length": "word_chars / n_words",
    "symbol_share": "n_symbols / word_chars",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
    "upper_share": "n_upper / word_chars",
    "mark_share": "n_marks / word_chars",
    "digit_share": "n_digits / word_chars",
    "distinct_share": "n_distinct / n_words",
    "line_words": "n_words / n_lines",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _repeated(windows: Column) -> Column:
    """Words that lie in a window whose hash comes twice or more."""
    order = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = let(order, lambda s: F.transform(s, lambda x, i: F.when(
        (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(F.sort_array(F.filter(twice, lambda p: p.isNotNull())), start, lambda a, p: F.struct(
        (a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - p)).alias("n"), (p + WINDOW).alias("end")))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(covered["n"])


def _without(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def measured(docs: DataFrame, carry: list[Column]) -> DataFrame:
    """``carry`` and the statistics of every row's whole ``text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*carry, text.alias("_text"))
    names = rows.columns[:-1]
    rows = rows.withColumns({
        "_words": F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)),
        "_lines": F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD)),
    })
    rows = rows.withColumn("_windows", F.when(F.size("_words") < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW),
                    lambda i: F.xxhash64(*(F.get("_words", i + k) for k in range(WINDOW))))))
    t = F.col("_text")
    return rows.select(
        *names,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _without(t, SYMBOL).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("_windows")).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        _without(t, r"\p{Lu}+").alias("n_upper"),
        _without(t, "!+").alias("n_marks"),
        _without(t, "[0-9]+").alias("n_digits"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def with_features(rows: DataFrame) -> DataFrame:
    """The features as doubles; where a divisor is 0 (texts without words) the feature is 0."""
    made = {k: F.coalesce(F.expr(e.replace(" / ", " / nullif(") + ", 0)" if "/" in e else e).cast("double"), F.lit(0.0))
            for k, e in FEATURES.items() if k not in rows.columns}
    return rows.withColumns(made)


def _thresholds(train: DataFrame) -> dict[str, list[float]]:
    got = train.agg(*(F.percentile_approx(F.col(f).cast("double"), QUANTILES, 10000).alias(f) for f in FEATURES)).first()
    return {f: sorted(set(got[f] or [])) for f in FEATURES}


def _count(rows: DataFrame) -> list[tuple[int, int, int, int]]:
    """(feature number, bin, bad, good): at most features x bins rows."""
    cells = rows.select("bad", F.posexplode("bins").alias("f", "b")).groupBy("f", "b").agg(
        F.sum(F.col("bad").cast("long")).alias("p"), F.sum((~F.col("bad")).cast("long")).alias("n"))
    return [(r["f"], r["b"], r["p"], r["n"]) for r in cells.collect()]


def _best(cells, thresholds: dict[str, list[float]]):
    """(gain, feature number, whether above, threshold number, bad, good) of the best next condition."""
    by: dict[int, dict[int, tuple[int, int]]] = {}
    for f, b, p, n in cells:
        by.setdefault(f, {})[b] = (p, n)
    best = None
    for f, feature in enumerate(FEATURES):
        bins = by.get(f, {})
        all_p, all_n = (sum(x[i] for x in bins.values()) for i in (0, 1))
        if not all_p:
            continue
        before = math.log2(all_p / (all_p + all_n))
        low_p = low_n = 0
        for k in range(len(thresholds[feature])):
            p, n = bins.get(k, (0, 0))
            low_p, low_n = low_p + p, low_n + n
            for above, p1, n1 in ((False, low_p, low_n), (True, all_p - low_p, all_n - low_n)):
                if p1 >= LEAST_SUPPORT:
                    gain = p1 * (math.log2(p1 / (p1 + n1)) - before)
                    if best is None or gain > best[0]:
                        best = (gain, f, above, k, p1, n1)
    return best


def _on_bins(rule: list[tuple[int, bool, int]]) -> Column:
    tests = [F.get("bins", F.lit(f)) > k if above else F.get("bins", F.lit(f)) <= k for f, above, k in rule]
    return reduce(Column.__and__, tests)


def learn(rows: DataFrame, labels: DataFrame, work: Workspace) -> list[Rule]:
    """Rules that tell bad documents (quality 0) among measured ``rows`` that pass the base rules."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select(F.col("doc_id").alias("_id"), "quality")
    train = with_features(rows.where(~F.col("base_failed"))).join(known, F.col("doc_id") == F.col("_id")).select(
        "doc_id", (F.col("quality") == 0).alias("bad"), *FEATURES)
    train = work.save(train, "labelled")
    thresholds = _thresholds(train)
    bins = F.array(*(reduce(Column.__add__, [(F.col(f) > t).cast("int") for t in ts], F.lit(0)) for f, ts in thresholds.items()))
    left = work.save(train.select("bad", bins.alias("bins"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) < 2).alias("grow")), "binned")
    names, rules = list(FEATURES), []
    while len(rules) < MOST_RULES:
        rule: list[tuple[int, bool, int]] = []
        growing = left.where("grow")
        while len(rule) < MOST_CONDITIONS:
            best = _best(_count(growing), thresholds)
            if best is None or best[0] <= 0:
                break
            rule.append(best[1:4])
            growing = left.where("grow").where(_on_bins(rule))
            if best[5] == 0:
                break
        if not rule:
            break
        kept = [F.sum((_on_bins(rule[:k]) & (F.col("bad") if bad else ~F.col("bad"))).cast("long")).alias(f"{'pn'[not bad]}{k}")
                for k in range(1, len(rule) + 1) for bad in (True, False)]
        held = left.where("NOT grow").agg(*kept).first()
        worth = [((held[f"p{k}"] or 0) / max(1, (held[f"p{k}"] or 0) + (held[f"n{k}"] or 0)), -k) for k in range(1, len(rule) + 1)]
        precision, k = max(worth)
        if precision < LEAST_PRECISION or (held[f"p{-k}"] or 0) < LEAST_SUPPORT - 1:
            break
        rule = rule[:-k]
        rules.append(tuple(Condition(names[f], above, thresholds[names[f]][t]) for f, above, t in rule))
        left = left.where(~_on_bins(rule))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list over ``with_features``: the first rule that holds rejects, else the document is kept."""
    out = F.when(F.col("base_failed"), F.lit(False))
    for rule in rules:
        out = out.when(reduce(Column.__and__, [c.column() for c in rule]), F.lit(False))
    return out.otherwise(F.lit(True))


def judged(docs: DataFrame, labels: DataFrame, work: Workspace) -> DataFrame:
    """(doc_id, counts, base_failed, kept) of every document."""
    rows = work.save(measured(docs, [F.col("doc_id")]), "measured")
    rules = learn(rows, labels, work)
    return with_features(rows).withColumn("kept", verdict(rules)).select("doc_id", *COUNTS, "base_failed", "kept")


def kept_documents(docs: DataFrame, labels: DataFrame, work: Workspace) -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged.

    The verdict depends on the text alone, so it is given to a hash of each
    text, and rows with a rejected one are taken out.
    """
    rows = work.save(measured(docs, [F.col("doc_id"), text_key("text").alias("key")]), "measured")
    rules = learn(rows, labels, work)
    bad = with_features(rows).where(~verdict(rules)).select(F.col("key").alias("_bad")).distinct()
    bad = small(work.save(bad, "rejected"))
    return docs.withColumn("_mf_key", text_key("text")).join(bad, F.col("_mf_key") == F.col("_bad"), "left_anti").select(
        *(F.col(f"`{c}`") for c in docs.columns))
