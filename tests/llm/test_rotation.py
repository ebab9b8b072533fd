"""Fill-in-the-middle against a plain version of the contract, by slicing instead of rotations."""

import hashlib
import random
import re

import pytest
from brute import awkward, rows

from mendframe.llm import fill_middle
from mendframe.llm.queries import QUERIES


def plain_fim(doc_id, text):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    n = len(units)
    if doc_id is None or not t or any(s in t for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, t
    h = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    if h3 % 100 >= 100:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = f"<S>{suf}<P>{pre}<M>{mid}" if h4 % 100 < 50 else f"<P>{pre}<S>{suf}<M>{mid}"
    return n, "spm" if h4 % 100 < 50 else "psm", len(pre), len(mid), out


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


TEXTS = [None, "", "one line", "a\nb\nc\n", "\n\n\n", "x\n" * 50, "ends\nwithout", "<P> inside\nand more\n",
         "é😀\nß\n中文\n", "a<S\n>b\nc", "<\nS>\n", "long " * 20000 + "\n" + "tail\n" * 300, "a\r\nb\rc\n", "same\nsame\n", "same\nsame\n"]


def test_round_trip_of_random_texts():
    rnd = random.Random(3)
    for i in range(3000):
        t = "".join(rnd.choice(["a", "é", "\n", "<", "S", ">", "M", "P", "😀", " ", "\r"]) for _ in range(rnd.randint(0, 60)))
        form, n, pc, mc, out = fill_middle.transform(t, i)
        assert (n, form, pc, mc, out) == plain_fim(i, t)
        assert fill_middle.restore(out, form) == t


def test_rotation_is_three_reversals():
    buf = bytearray(b"abcdefg")
    fill_middle.rotate(buf, 1, 3, 7)
    assert buf == bytearray(b"adefgbc")


def test_awkward_rows(spark):
    ids = list(range(len(TEXTS) - 1)) + [len(TEXTS) - 2]   # a repeated row
    df = awkward(spark, TEXTS, ids)
    got = {(r["doc_id"], r["text"]): r for r in rows(fill_middle.fill_in_middle(df).withColumn("back", fill_middle.restored()))}
    assert len(got) == len(set(zip(ids, TEXTS)))
    for (i, t), r in got.items():
        n, form, pc, mc, out = plain_fim(i, t)
        assert (r["fim_n"], r["fim_form"], r["fim_prefix_chars"], r["fim_middle_chars"], r["fim_text"]) == (n, form, pc, mc, out)
        assert r["back"] == (t or "")
        assert r["score"] == "x"   # extra columns pass through


def test_null_doc_id_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a\nb\n")], "doc_id long, text string")
    r = rows(fill_middle.fill_in_middle(df))[0]
    assert (r["fim_form"], r["fim_text"], r["fim_n"]) == ("plain", "a\nb\n", 2)
    empty = spark.createDataFrame([], "doc_id long, text string, fim_text string")
    assert fill_middle.fill_in_middle(empty).count() == 0


@pytest.mark.parametrize("sf_name", ["sf0.001"])
def test_query_whole_table(spark, sf, sf_name):
    got = rows(QUERIES["op11_block_rotation"](spark, sf))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(docs)
    for r in got:
        n, form, pc, mc, out = plain_fim(r["doc_id"], docs[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"]) == (n, form, pc, mc, sha(out))
        assert r["restored_sha256"] == sha(docs[r["doc_id"]] or "")
