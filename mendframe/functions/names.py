"""Column-name rules: snake case, uniqueness, ignorable names."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import _col, strip


def snake_case(c) -> Column:
    """Import-friendly form of a name held in a column."""
    kept = F.regexp_replace(F.lower(_col(c)), r"(?U)[^\p{L}\p{N}_\s\x{1c}-\x{1f}]", "")
    joined = F.regexp_replace(kept, r"(?U)[\s\x{1c}-\x{1f}_]+", "_")
    return F.regexp_replace(F.btrim(joined, F.lit("_")), r"\A\z", "col")


def snake_names(names: Column) -> Column:
    """Snake-case every element of an array of names."""
    return F.transform(names, snake_case)


def unique_names(names) -> Column:
    """Make an array of names unique, in position order.

    A repeat gets the first free suffix ``_2``, ``_3``, ...; the suffix never
    collides with a name that was already given out.
    """
    names = _col(names)

    def place(done, name):
        tries = F.transform(F.sequence(F.lit(2), F.size(names) + 2), lambda i: F.concat(name, F.lit("_"), i.cast("string")))
        free = F.element_at(F.filter(tries, lambda t: ~F.array_contains(done, t)), 1)
        return F.array_append(done, F.when(F.array_contains(done, name), free).otherwise(name))

    return F.when(F.size(F.array_distinct(names)) == F.size(names), names).otherwise(
        F.aggregate(names, F.array().cast("array<string>"), place)
    )


def is_ignorable_name(c) -> Column:
    """True for id, reference, date/time and balance columns."""
    return strip(F.lower(_col(c))).rlike(K.IGNORED_NAME)


# --- the same rules for the handful of names of a DataFrame schema ---------

def snake_case_name(name: str) -> str:
    kept = "".join(c for c in str(name).lower() if c.isalnum() or c == "_" or c.isspace())
    return "_".join(filter(None, re.split(r"[\s_]+", kept))) or "col"


def unique_name_list(names: Iterable[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        n, candidate = 1, name
        while candidate in out:
            n += 1
            candidate = f"{name}_{n}"
        out.append(candidate)
    return out


def ignorable_columns(columns: Iterable[str]) -> list[str]:
    return [c for c in columns if re.search(K.IGNORED_NAME, str(c).lower().strip())]
