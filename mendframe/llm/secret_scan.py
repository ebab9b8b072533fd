"""Secret scans with character Markov models (native).

Two first-order models over characters, one of random strings and one of
ordinary identifiers, are trained from labelled samples: values that the strict
patterns matched, and words and identifiers outside them that recur.  A token of 12
characters or more is a secret when the random model explains it better: its
log-likelihood ratio for each transition and in all must reach a threshold.

Transitions are counted by Spark; the driver sees at most 64 * 64 counts for each
model.  Strict spans always stay.  Of a token that they overlap, the parts
outside are looked at: those of 12 characters or more by themselves, shorter
ones of letters and digits with the whole token, unless it holds an assignment.

Defined cases: a null or empty text has no spans; repeated rows count as often
as they stand; without samples both models are uniform and nothing is added;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe.functions.text import let
from mendframe.sources.workspace import Workspace

from .spans import SPAN, found, found_if, joined

KINDS = ["assign", "access", "hex", "random"]
KEY = r"(?i:password|passwd|secret|token|api_?key)"
VALUE = r"[A-Za-z0-9+/_.=-]"
ASSIGN = rf"""{KEY}["']?\x20*+[:=]\x20*+["']?{VALUE}++"""
VALUE_AT_END = rf"""^{KEY}["']?\x20*+[:=]\x20*+["']?({VALUE}++)$"""
ASSIGN_KEY = rf"""({KEY}["']?\x20*+[:=]\x20*+["']?){VALUE}++"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]{16,}+"
#: Least length of a token that is scored.
LONG = 12
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LONG},}}+"
#: Words, numbers, and identifiers that end in digits, as samples of what isn't random.
ORDINARY = (r"(?<![A-Za-z0-9])(?:[A-Za-z_]{6,}+(?![A-Za-z0-9])"
            r"|(?<![+/_=-])(?=[A-Za-z0-9_]{6})(?:[A-Za-z]{3,}+_*+)*+[0-9]++(?![A-Za-z0-9+/_=-]))")
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits
STATES = 64
#: Sizes of the labelled samples (give or take their square roots): matched values, and documents whose words are the
#: ordinary identifiers.
SAMPLE_VALUES = 20_000
SAMPLE_DOCS = 2_000
#: Least log-likelihood ratio for each transition, and in all.
EACH = 0.25
IN_ALL = 6.0


def base_spans(text: Column) -> dict[str, Column]:
    """Arrays of (s, e, m) of the three base kinds."""
    low = F.lower(text)
    named = reduce(Column.__or__, [F.contains(low, F.lit(k)) for k in ("passw", "secret", "token", "key")])
    return {
        "assign": F.filter(found_if(named, text, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], VALUE_AT_END, 1)) >= 12),
        "access": F.filter(found_if(F.contains(text, F.lit("AKIA")), text, ACCESS), lambda x: F.length(x["m"]) >= 18),
        "hex": found(text, HEX),
    }


def _free_parts(x: Column, over: Column) -> Column:
    """Array of (s, e, m): the token where no strict span is over it, else the parts outside them that can be scored."""
    none = F.array().cast(SPAN)

    def cut(acc: Column, b: Column) -> Column:
        part = F.array(F.struct(acc["at"].alias("s"), b["s"].alias("e"), F.substring(x["m"], acc["at"] - x["s"] + 1, b["s"] - acc["at"]).alias("m"))).cast(SPAN)
        return F.struct(F.greatest(acc["at"], b["e"]).alias("at"), F.when(b["s"] > acc["at"], F.concat(acc["out"], part)).otherwise(acc["out"]).alias("out"))

    stops = F.concat(F.sort_array(F.transform(over, lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e")))), F.array(F.struct(x["e"].alias("s"), x["e"].alias("e"))))
    parts = F.aggregate(stops, F.struct(x["s"].alias("at"), none.alias("out")), cut, lambda acc: acc["out"])
    assigned = F.exists(over, lambda b: b["kind"] == 0)
    scored = F.transform(parts, lambda p: F.struct(p["s"].alias("s"), p["e"].alias("e"), F.when(F.length(p["m"]) >= LONG, p["m"]).when(
        ~assigned & p["m"].rlike("^[A-Za-z0-9]+$"), x["m"]).alias("m")))
    return F.when(F.size(over) == 0, F.array(x)).otherwise(F.filter(scored, lambda p: p["m"].isNotNull()))


def candidates(docs: DataFrame, carry: list[Column] | None = None) -> DataFrame:
    """``carry`` (doc_id if not given) and spans: (kind, s, e, m) of strict kinds and of long tokens; ``m`` is what is scored."""
    rows = docs.select(*(carry or [F.col("doc_id")]), F.coalesce("text", F.lit("")).alias("_text"))
    names, text = rows.columns[:-1], F.col("_text")
    rows = rows.withColumns({f"_{k}": v for k, v in base_spans(text).items()})
    kind = lambda k, xs: F.transform(xs, lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))
    rows = rows.withColumn("_strict", F.concat(*(kind(i, f"_{k}") for i, k in enumerate(KINDS[:3]))))
    tokens = F.flatten(F.transform(found(text, TOKEN), lambda x: _free_parts(x, F.filter(
        "_strict", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))))
    return rows.select(*names, F.concat("_strict", kind(3, tokens)).alias("spans"))


def _state(c: Column) -> Column:
    """0 for any other character, else its place in the alphabet from 1."""
    return F.instr(F.lit(ALPHABET), c)


def _transitions(token: Column) -> Column:
    """Numbers of the token's transitions, from * STATES + to."""
    states = F.transform(F.split(token, ""), _state)
    return let(states, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(s) - 1)),
                                             lambda i: F.get(s, i - 1) * STATES + F.coalesce(F.get(s, i), F.lit(0))))


def _model(tokens: DataFrame) -> list[float]:
    """Log-probabilities of all transitions from (token, n) rows, with half a count added to each."""
    counts = [[0.5] * STATES for _ in range(STATES)]
    for r in tokens.select(F.explode(_transitions(F.col("token"))).alias("t"), "n").groupBy("t").agg(F.sum("n").alias("n")).collect():
        counts[r["t"] // STATES][r["t"] % STATES] += r["n"]
    return [math.log(x / sum(row)) for row in counts for x in row]


def _sample(rows: DataFrame, size: int, *columns: str) -> DataFrame:
    """About ``size`` rows, chosen by a hash of the columns where they stand; all of them if there are no more."""
    n = rows.count()
    return rows if n <= size else rows.where(F.pmod(F.xxhash64(*columns), F.lit(1 << 31)) < int(size / n * (1 << 31)))


def train(docs: DataFrame, rows: DataFrame) -> list[float]:
    """Log-likelihood ratios random : ordinary of all transitions."""
    strict = rows.select(F.explode("spans").alias("x")).where("x.kind < 3").select(
        F.when(F.col("x.kind") == 0, F.regexp_extract("x.m", VALUE_AT_END, 1)).otherwise(F.col("x.m")).alias("token")).distinct()
    random = _sample(strict, SAMPLE_VALUES, "token")
    sample = _sample(docs.select("doc_id", "text"), SAMPLE_DOCS, "doc_id")
    outside = F.regexp_replace(F.regexp_replace("text", ASSIGN_KEY, "$1 "), f"{ACCESS}|{HEX}", " ")
    words = sample.select(F.explode(F.regexp_extract_all(outside, F.lit(ORDINARY), F.lit(0))).alias("token"), F.xxhash64("text").alias("of"))
    # random strings stand in one text; words recur
    words = words.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("of").alias("texts")).where("texts > 1")
    many, few = _model(random.withColumn("n", F.lit(1))), _model(words)
    return [a - b for a, b in zip(many, few, strict=True)]


def accepted(ratios: list[float]) -> Column:
    """Strict spans and the tokens that look random; (kind, s, e, m) structs."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")

    def looks_random(x: Column) -> Column:
        return let(_transitions(x["m"]), lambda ts: let(
            F.aggregate(ts, F.lit(0.0), lambda a, t: a + F.get(table, t)),
            lambda total: (total >= IN_ALL) & (total >= EACH * F.size(ts))))

    return F.filter("spans", lambda x: F.when(x["kind"] < 3, F.lit(True)).otherwise(looks_random(x)))


def find(docs: DataFrame, work: Workspace) -> DataFrame:
    """(doc_id, counts of the strict kinds, base_sha256, spans, found) of every document; ``found`` lists (kind, s, e)."""
    rows = work.save(candidates(docs), "secret_candidates")
    names = F.array(*map(F.lit, KINDS))
    got = rows.select("doc_id", F.transform(accepted(train(docs, rows)), lambda x: F.struct(
        F.get(names, x["kind"]).alias("kind"), x["kind"].alias("no"), x["s"].alias("s"), x["e"].alias("e"))).alias("found"))
    of = lambda i: lambda x: x["no"] == i
    count = [F.size(F.filter("found", of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    base = F.filter("found", lambda x: x["no"] < 3)
    return got.select("doc_id", *count, F.sha2(joined(base, "s", "no").cast("binary"), 256).alias("base_sha256"),
                      joined(F.col("found"), "s", "no").alias("spans"), "found")


def redacted(docs: DataFrame, work: Workspace, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced; ``n_chars``, where there is one, follows."""
    rows = work.save(candidates(docs), "secret_candidates")
    ratios = train(docs, rows)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    found_ = candidates(docs, [row]).select("_row", F.sort_array(F.transform(accepted(ratios), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))).alias("_found"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    text = F.col("_row.text")

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), x["s"] - acc["at"]))
        inside = x["s"] < acc["at"]  # overlaps the span before, which is masked already
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(gap, F.lit(mask)))).alias("out"))

    clean = F.aggregate("_found", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    out = found_.withColumn("_clean", F.when(F.size("_found") == 0, text).otherwise(clean))
    changed = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("_found") == 0, F.col("_row.n_chars")).otherwise(F.length("_clean")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))
