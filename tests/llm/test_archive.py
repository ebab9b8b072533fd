"""ARC to WARC: plain revisit decisions, both ARC versions, hot payloads, awkward pages."""

import hashlib

import pytest
from brute import rows

from mendframe.llm import keys, web_archive
from mendframe.llm.queries import QUERIES
from mendframe.sources.workspace import Workspace


def plain_archive(pages):
    out = {}
    heads = {}
    for k, (pid, _, html) in enumerate(pages):
        body = (html or "").encode()
        if len(body) >= 1000:
            d = hashlib.sha1(body).hexdigest()
            key = (pid is not None, pid if pid is not None else 0, k)
            heads[d] = max(heads.get(d, key), key)
    for k, (pid, _, html) in enumerate(pages):
        body = (html or "").encode()
        d = hashlib.sha1(body).hexdigest()
        h = heads.get(d) if len(body) >= 1000 else None
        revisit = h is not None and h[2] != k
        out[k] = (pid, len(body), d, "revisit" if revisit else "response", (h[1] if h[0] else None) if revisit else None)
    return sorted(out.values(), key=repr)


def got_of(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows(df)), key=repr)


BIG = "<html>" + "é" * 600 + "</html>"
PAGES = [(1, "http://a/ b c", BIG), (2, None, BIG), (3, "http://c", None), (4, "http://d", "short"), (5, "http://e", "short"),
         (6, "http://f", BIG + "x"), (None, "http://g", BIG), (8, "http://h\nnext", "line\r\nend" * 200), (9, "u", "line\r\nend" * 200),
         (10, "u", "z" * 50000), (2, "again", BIG)]


@pytest.mark.parametrize("version", [1, 2])
def test_awkward_pages_both_versions(spark, version):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    got = got_of(web_archive.archive_round_trip(pages, Workspace(spark), version))
    assert got == plain_archive(PAGES)


def test_arc_lines_of_version_two():
    arc = web_archive.ArcFile(0, 2)
    text = "\n".join([arc.first, arc.record(7, "http://x y", "<p>hi</p>"), arc.record(8, "http://z", "")]) + "\n"
    recs = list(web_archive.parse_arc(text.encode()))
    assert [r[1] for r in recs] == [2, 2]
    assert recs[0][2] == "http://x y" and recs[0][4] == web_archive.ARCHIVE_DATE
    header = text.encode()[recs[1][0]:].split(b"\n", 1)[0].decode().split(" ")
    assert int(header[7]) == recs[1][0]      # the offset field names where the record starts
    fields, body = web_archive.split_http(recs[0][5])
    assert (web_archive.page_of(fields), body) == (7, b"<p>hi</p>")


def test_hot_payloads_are_broadcast_and_exact(spark, monkeypatch):
    monkeypatch.setattr(keys, "MIN_HOT_ROWS", 5)
    monkeypatch.setattr(keys, "HOT_KEYS", 10)
    pages = [(i, f"u{i}", BIG if i % 3 else f"{i}" * 1000) for i in range(300)] + [(1000 + i, "s", "tiny") for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    assert got_of(web_archive.archive_round_trip(df, Workspace(spark))) == plain_archive(pages)


def test_lookup_hot_cold_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(keys, "MIN_HOT_ROWS", 3)
    big = spark.createDataFrame([(i, "h" if i < 50 else (None if i % 7 == 0 else f"k{i % 4}")) for i in range(80)], "i long, k string")
    small = spark.createDataFrame([("h", 1), ("k1", 2), ("k9", 3)], "k string, v long")
    got = {r["i"]: r["v"] for r in keys.lookup(big, small, "k").collect()}
    want = {i: (1 if i < 50 else (2 if i % 7 and i % 4 == 1 else None)) for i in range(80)}
    assert got == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, spans string")
    assert web_archive.archive_round_trip(empty, Workspace(spark)).count() == 0


def test_query_whole_table(spark, sf):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert got_of(QUERIES["op12_arc_to_warc"](spark, sf)) == plain_archive(pages)
