"""Places of pattern matches in a text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mendframe.functions.text import let

SPAN = "array<struct<s:int,e:int,m:string>>"


def found(text: Column, pattern: str) -> Column:
    """Array of (s, e, m): leftmost non-overlapping matches with start, end (code points, end exclusive) and text.

    The pattern mustn't match the empty string.  Starts are sums of the lengths
    of the gaps and matches before them.
    """
    none = F.array().cast(SPAN)

    def placed(matches: Column) -> Column:
        pairs = F.zip_with(F.split(text, pattern, -1), matches, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(acc: Column, x: Column) -> Column:
            s = acc["at"] + x["gap"]
            e = s + F.coalesce(F.length(x["m"]), F.lit(0))
            one = F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"))).cast(SPAN)
            return F.struct(e.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

        return F.aggregate(pairs, start, step, lambda acc: acc["out"])

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
               lambda m: F.when(F.size(m) == 0, none).otherwise(placed(m)))


def found_if(test: Column, text: Column, pattern: str) -> Column:
    """``found`` where a cheap test holds; no span elsewhere."""
    return F.when(test, found(text, pattern)).otherwise(F.array().cast(SPAN))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def passes_luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    n = F.length(number)
    one = lambda i: F.substring(number, n - i, F.lit(1)).cast("int")
    doubled = lambda i: let(one(i) * 2, lambda d: d - F.when(d > 9, F.lit(9)).otherwise(F.lit(0)))
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0),
                        lambda a, i: a + F.when(i % 2 == 0, one(i)).otherwise(doubled(i)))
    return F.when(n > 0, total % 10 == 0).otherwise(F.lit(False))


def joined(spans: Column, *order: str) -> Column:
    """``kind:start:end`` of (kind, s, e, ...) structs, sorted by the fields named, comma-joined."""
    sorted_ = F.sort_array(F.transform(spans, lambda x: F.struct(*(x[f].alias(f) for f in order), x["kind"].alias("name"), x["s"].alias("from"), x["e"].alias("to"))))
    return F.array_join(F.transform(sorted_, lambda x: F.concat_ws(":", x["name"], x["from"], x["to"])), ",")
