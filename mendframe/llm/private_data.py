"""Personal data by weak supervision (native).

Patterns propose spans: the strict ones of the four kinds (e-mail, ip, card,
phone) and looser ones of the same kinds.  Four labelers vote yes, no or nothing on each
span: a pattern check (strict form), a gazetteer (endings, number ranges,
address blocks), the words before the span, and the look of its digits.
Expectation-maximisation estimates from the votes alone how reliable each
labeler is (a two-class model with three answers for each labeler).  Its
posteriors train the final classifier, a naive Bayes model over the span's
kind, votes, length and surroundings.

The votes of all documents come down to a table of at most 4 * 81 patterns and
the classifier's features to a few dozen counts, which Spark aggregates.

Strict spans always stay; a loose one is added if the classifier accepts it
and no strict span overlaps it.

Defined cases: a null or empty text has no spans; repeated rows are counted as
often as they stand; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe.functions.text import let
from mendframe.sources.workspace import Workspace

from .spans import digits, found_if, joined, passes_luhn

KINDS = ["email", "ip", "card", "phone"]
LOCAL = "A-Za-z0-9._%+-"
# Possessive forms of the base patterns.  A match can only begin where no character that it could begin with stands
# before (or where the last match ended), so no run of characters is tried from each of its places.
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[a-z0-9-]{1,63}+ ?(?:[\[(]dot[\])]|\.) ?[a-z]{2,24}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
}
CUES = {
    "email": r"(?i)(e-?mail|contact|write|reply|kontakt|courriel|correo)",
    "ip": r"(?i)(\bip\b|host|server|address|login|from)",
    "card": r"(?i)(card|visa|credit|payment|karte|carte|tarjeta)",
    "phone": r"(?i)(phone|\btel|call|fax|mobile|cell|telefon)",
}
AGAINST = r"(?i)(version|isbn|issn|order|invoice|item|serial|figure|page|chapter)"
#: Characters before a span in which words speak for or against it.
BEFORE = 24
LABELERS = 4
PATTERNS = len(KINDS) * 3 ** LABELERS
ROUNDS = 50


def base_spans(text: Column) -> dict[str, Column]:
    """Arrays of (s, e, m) of the four base kinds."""
    octets = lambda m: F.forall(F.split(m, r"\.", -1), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)
    long_enough = lambda m: F.length(digits(m)).between(8, 15)
    return {
        "email": found_if(F.contains(text, F.lit("@")), text, EMAIL),
        "ip": F.filter(found_if(text.rlike(r"[0-9]\.[0-9]"), text, IP), lambda x: octets(x["m"])),
        "card": F.filter(found_if(text.rlike("[0-9]"), text, CARD), lambda x: passes_luhn(digits(x["m"]))),
        "phone": F.filter(found_if(F.contains(text, F.lit("+")), text, PHONE), lambda x: long_enough(x["m"])),
    }


def _vote(yes: Column, no: Column) -> Column:
    """2 yes, 0 no, 1 nothing."""
    return F.when(yes, 2).when(no, 0).otherwise(1)


def _gazetteer(kind: str, m: Column) -> Column:
    if kind == "email":
        ending = F.lower(F.regexp_extract(m, r"([A-Za-z]+)$", 1))
        return _vote(ending.isin("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu"), F.length(ending) < 2)
    if kind == "ip":
        return _vote(m.rlike(r"^(?!0|127\.|255\.)[0-9]{1,3}\."), m.rlike(r"^(0|127|255)\."))
    if kind == "card":
        return _vote(digits(m).rlike(r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"), digits(m).rlike("^[01789]"))
    return _vote(digits(m).rlike(r"^(1[2-9]|3[0-9]|4[0-9]|5[0-8]|6[0-6]|7|8[1-6]|9[0-58])"), digits(m).rlike("^0000"))


def _candidate(text: Column, number: int, x: Column, base: bool) -> Column:
    kind = KINDS[number]
    before = F.substring(text, F.greatest(F.lit(1), x["s"] + 1 - BEFORE), F.least(x["s"], F.lit(BEFORE)))
    m, d = x["m"], digits(x["m"])
    check = F.lit(2) if base else (passes_luhn(d).cast("int") * 2 if kind == "card" else F.lit(1))
    varied = F.size(F.array_distinct(F.split(d, "")))
    look = _vote(varied >= 4, (varied <= 2) & (F.length(d) > 6)) if kind != "email" else _vote(m.rlike("[a-z]"), m.rlike("(.)\\1{5}"))
    votes = [check, _gazetteer(kind, m), _vote(before.rlike(CUES[kind]), before.rlike(AGAINST)), look]
    pattern = reduce(lambda a, v: a * 3 + v, votes, F.lit(number))
    size = F.least(F.lit(7), F.floor(F.log2(F.length(m)))).cast("int")
    edge = F.when(F.length(before) == 0, 0).when(before.rlike(r"[A-Za-z0-9]$"), 1).when(before.rlike(r"\s$"), 2).otherwise(3)
    return F.struct(F.lit(number).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lit(base).alias("base"),
                    pattern.cast("int").alias("pattern"), size.alias("size"), edge.alias("edge"))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): strict and loose spans of every row with their votes; narrow, however long the texts are."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    text = F.col("_text")
    rows = rows.withColumns({f"_{k}": v for k, v in base_spans(text).items()})
    tests = {"email": text.rlike(r"(?i)[\[(]at[\])]"), "ip": text.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]"), "card": text.rlike("[0-9][ -]?[0-9]{3}"), "phone": text.rlike("[0-9][ .-][0-9]{4}")}
    rows = rows.withColumns({f"_loose_{k}": found_if(tests[k], text, p) for k, p in LOOSE.items()})
    strict = F.flatten(F.array(*(F.transform(f"_{k}", lambda x: F.struct(x["s"], x["e"])) for k in KINDS)))
    rows = rows.withColumn("_strict", strict)
    free = lambda x: ~F.exists("_strict", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    voted = lambda i, base: lambda x: _candidate(text, i, x, base)
    all_ = [F.transform(f"_{k}", voted(i, True)) for i, k in enumerate(KINDS)]
    all_ += [F.transform(F.filter(f"_loose_{k}", free), voted(i, False)) for i, k in enumerate(KINDS)]
    return rows.select("doc_id", F.concat(*all_).alias("spans"))


def reliabilities(counts: dict[int, int]) -> tuple[list[float], list[list[list[float]]]]:
    """Posterior of each vote pattern, and P(answer | class) for each labeler, by expectation-maximisation.

    ``counts`` has at most PATTERNS entries.  It starts from labelers that are
    right four times in five when they answer.
    """
    answers = {p: [p // 3 ** (LABELERS - 1 - j) % 3 for j in range(LABELERS)] for p in counts}
    prior = [0.5] * len(KINDS)
    says = [[[0.55, 0.3, 0.15], [0.15, 0.3, 0.55]] for _ in range(LABELERS)]
    post: dict[int, float] = {}
    for _ in range(ROUNDS):
        for p, a in answers.items():
            k = p // 3 ** LABELERS
            odds = math.log(prior[k] / (1 - prior[k])) + sum(math.log(says[j][1][v] / says[j][0][v]) for j, v in enumerate(a))
            post[p] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        for k in range(len(KINDS)):
            mine = [(n, post[p]) for p, n in counts.items() if p // 3 ** LABELERS == k]
            prior[k] = (1 + sum(n * q for n, q in mine)) / (2 + sum(n for n, _ in mine))
        for j in range(LABELERS):
            for c in (0, 1):
                mass = [1.0 + sum(n * (post[p] if c else 1 - post[p]) for p, n in counts.items() if answers[p][j] == v) for v in range(3)]
                says[j][c] = [x / sum(mass) for x in mass]
    return [post.get(p, 0.0) for p in range(PATTERNS)], says


def _features(x: Column) -> list[Column]:
    """The classifier's features as small numbers: votes by kind, length by kind, the character before."""
    votes = [x["kind"] * 3 + F.floor(x["pattern"] / 3 ** (LABELERS - 1 - j)).cast("int") % 3 for j in range(LABELERS)]
    return [*votes, x["kind"] * 8 + x["size"], x["edge"]]


WIDTH = 32


def train(rows: DataFrame) -> list[float]:
    """Naive Bayes log-odds, entry 0 the prior, then WIDTH for each feature; trained on the posteriors of all spans."""
    spans = rows.select(F.explode("spans").alias("x"))
    counts = {r["pattern"]: r["n"] for r in spans.groupBy(F.col("x.pattern").alias("pattern")).agg(F.count(F.lit(1)).alias("n")).collect()}
    post, _ = reliabilities(counts)
    soft = F.get(F.array(*map(F.lit, post)), F.col("x.pattern"))
    cells = spans.select(soft.alias("q"), F.posexplode(F.array(*_features(F.col("x")))).alias("f", "v")).groupBy("f", "v").agg(
        F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no")).collect()
    total = {p: n * post[p] for p, n in counts.items()}
    yes, no = 1 + sum(total.values()), 1 + sum(n - total[p] for p, n in counts.items())
    weights = [math.log(yes / no)] + [0.0] * (WIDTH * (LABELERS + 2))
    for r in cells:
        weights[1 + r["f"] * WIDTH + r["v"]] = math.log((r["yes"] + 0.5) / (yes + 8)) - math.log((r["no"] + 0.5) / (no + 8))
    return weights


def accepted(weights: list[float]) -> Column:
    """The spans that stay: strict ones, and those that the classifier takes; (kind, s, e, base) structs."""
    w = F.array(*map(F.lit, weights))
    odds = lambda x: reduce(Column.__add__, [F.get(w, 1 + j * WIDTH + v) for j, v in enumerate(_features(x))], F.get(w, F.lit(0)))
    return F.filter("spans", lambda x: x["base"] | (odds(x) > 0))


def find(docs: DataFrame, work: Workspace) -> DataFrame:
    """(doc_id, counts of the strict kinds, base_sha256, spans, found) of every document; ``found`` lists (kind, s, e, base)."""
    rows = work.save(candidates(docs), "pii_candidates")
    names = F.array(*map(F.lit, KINDS))
    named = lambda xs: F.transform(xs, lambda x: F.struct(F.get(names, x["kind"]).alias("kind"), x["kind"].alias("no"), x["s"].alias("s"), x["e"].alias("e"), x["base"].alias("base")))
    got = rows.select("doc_id", named(accepted(train(rows))).alias("found"))
    base = F.filter("found", lambda x: x["base"])
    strict = lambda k: lambda x: x["base"] & (x["kind"] == k)
    count = [F.size(F.filter("found", strict(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return got.select("doc_id", *count, let(joined(base, "no", "s"), lambda s: F.sha2(s.cast("binary"), 256)).alias("base_sha256"),
                      joined(F.col("found"), "no", "s").alias("spans"), "found")
