"""Run a query and its SQL twin and compare names, rows and values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, q, sf_dir):
    """(rows, problem): problem is None when both sides agree."""
    df = q.run(spark, sf_dir)
    got_names = df.columns
    got = [tuple(r) for r in df.collect()]
    if q.sql is None:
        return len(got), None
    cur = con.execute(q.sql)
    want_names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(got_names) != sorted(want_names):
        return len(got), f"columns {got_names} != {want_names}"
    a, b = canonical(got_names, got), canonical(want_names, want)
    if a != b:
        only_a = [x for x in a if x not in set(b)][:2]
        only_b = [x for x in b if x not in set(a)][:2]
        return len(got), f"rows {len(a)} vs {len(b)}; spark only {str(only_a)[:600]}; sql only {str(only_b)[:600]}"
    return len(got), None
