"""Text, record, field and detection expressions against the standard library."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from mendframe.functions import detect as D
from mendframe.functions import text as X
from mendframe.functions.names import snake_case, unique_names, is_ignorable_name
from mendframe.functions.numbers import parse_number
from mendframe.operators.profile import profile

DELIMS = [",", ";", "\t", "|"]


def column(spark, values, expr, schema="x string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    return [r.y for r in df.select("i", expr.alias("y")).orderBy("i").collect()]


def random_lines(rng, n, alphabet, length=14):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(length))) for _ in range(n)]


@pytest.mark.parametrize("d", DELIMS)
def test_fields_match_csv_reader(spark, d):
    rng = random.Random(7)
    texts = random_lines(rng, 1500, 'ab" \'' + d + d + '""') + ['"' + "x," * 30000 + '"' + d + "b", ""]
    got = column(spark, texts, X.fields("x", d))
    want = [next(csv.reader([t], delimiter=d), []) for t in texts]
    assert got == want


@pytest.mark.parametrize("d", DELIMS)
def test_csv_records_match_csv_reader(spark, d):
    rng = random.Random(11)
    texts = random_lines(rng, 1200, 'ab"' + d + '\n"\n', 40)
    recs = X.csv_records("x", d)
    got = column(spark, texts, F.transform(recs, lambda r: X.fields(r, d)))
    want = [list(csv.reader(io.StringIO(t, newline=""), delimiter=d)) for t in texts]
    assert got == want


def parity_split(text):
    out, buf, quotes = [], [], 0
    for line in text.split("\n"):
        buf.append(line)
        quotes += line.count('"')
        if quotes % 2 == 0:
            out.append("\n".join(buf))
            buf = []
    if buf:
        out.append("\n".join(buf))
    return out


def test_parity_records(spark):
    rng = random.Random(3)
    texts = random_lines(rng, 1000, 'ab"\n\n', 30) + ["x" * 50000 + "\n" + '"' + "y\n" * 20000]
    got = column(spark, texts, X.parity_records("x"))
    assert got == [parity_split(t) for t in texts]
    assert all("\n".join(g) == t for g, t in zip(got, texts))


@pytest.mark.parametrize("text,stats", [
    ('a,"x\ny",b\nc,d\n"p\nq\nr",z\n', (7, 4, 2, 3)),
    ('a,"b\nc,d', (2, 1, 1, 2)),
    ('5" pipe,1\n6" pipe,2\n7,3', (3, 2, 1, 2)),
    ("", (1, 1, 0, 1)),
])
def test_stitch_stats(spark, text, stats):
    assert tuple(column(spark, [text], X.stitch_stats("x"))[0]) == stats


def sniff(lines):
    try:
        found = csv.Sniffer().sniff("\n".join(lines), delimiters=DELIMS).delimiter
        return found if found in DELIMS else None
    except csv.Error:
        return None


def test_delimiter_vote_matches_sniffer(spark):
    rng = random.Random(5)
    samples = []
    for _ in range(400):
        base = rng.choice(["a,b;", "ab;", "ab\t,", "a|b", "a b,\"", "ab;'\"", "xy"])
        n = rng.randrange(1, 31)
        if rng.random() < 0.6:
            d, w = rng.choice(DELIMS), rng.randrange(1, 5)
            samples.append([d.join(["v"] * (w if rng.random() < 0.93 else w + 1)) for _ in range(n)])
        else:
            samples.append([l for l in random_lines(rng, n, base, 20) if l.strip()])
    got = column(spark, samples, D.delimiter_vote(F.col("x")), "x array<string>")
    assert got == [sniff(s) for s in samples]


NUMBERS = {
    "1.234,56": 1234.56, "1 234,56": 1234.56, "12,34": 12.34, "(5,00)": -5.0, "1,234.56": 1234.56,
    "1,234": 1.234, "1,234,567": 1234567.0, "1 234,56": None, "1234": None, "1234.56": None,
    "1234,56": None, "$1,234.56": 1234.56, "-5": -5.0, "(-5)": 5.0, "(5": None, "$(5)": None, "($5)": -5.0,
    "1.234": 1.234, "1.234.567": None, "€ 5": 5.0, "+5": None, ".5": None, "5.": None, "1\t234,56": None,
    "": None, "  ": None, "()": None, "12a": None,
}


def test_parse_number(spark):
    assert column(spark, list(NUMBERS), parse_number("x")) == list(NUMBERS.values())


def test_names(spark):
    given = ["  Été—Prix (€) No² ", "__A  b__", "()", "a-b c", "Name"]
    assert column(spark, given, snake_case("x")) == ["étéprix_no²", "a_b", "col", "ab_c", "name"]
    lists = [["name", "name", "name"], ["a", "a", "a_2"], ["a", "b"], []]
    assert column(spark, lists, unique_names("x"), "x array<string>") == [
        ["name", "name_2", "name_3"], ["a", "a_2", "a_2_2"], ["a", "b"], []]
    yes = "id user_id id_card a_id_b uuid txn_no reference ref ref_no my_ref update_count lifetime created_at balance remaining".split()
    no = "valid name amount idea refund status".split()
    assert column(spark, yes + no, is_ignorable_name("x")) == [True] * len(yes) + [False] * len(no)


def test_encodings(spark):
    blobs = ["plain é".encode(), b"\xef\xbb\xbfa,b", "é€".encode("cp1252"), b"\x81\xe9", "“x”—".encode("cp1252")]
    assert column(spark, blobs, X.detect_encoding("x"), "x binary") == ["utf-8", "utf-8-sig", "cp1252", "latin-1", "cp1252"]
    assert column(spark, blobs, X.decode_file("x"), "x binary") == ["plain é", "a,b", "é€", "\x81é", "“x”—"]


def test_newlines_and_whitespace(spark):
    assert column(spark, ["a\r\nb\rc\n", "a\r\r\nb"], X.normalize_newlines("x")) == ["a\nb\nc\n", "a\n\nb"]
    assert column(spark, ["  a b \x1c"], X.strip("x")) == ["a b"]
    assert column(spark, ["a\n", "", "a\n\nb", "\n"], X.lines("x")) == [["a"], [], ["a", "", "b"], [""]]


def test_render_row_round_trip(spark):
    rows = [["a", "b,c", 'd"e', "f\ng"], [""], ["", ""], [" x "]]
    got = column(spark, rows, X.render_row("x", ","), "x array<string>")
    want = []
    for r in rows:
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(r)
        want.append(out.getvalue())
    assert got == want


def profiles(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return profile(df).orderBy("i").collect()


def test_profile_fixtures(spark):
    pre, title, low, none, euro = profiles(spark, [
        "Report: Q1\nGenerated 2024\nid,name,amount\n1,a,5\n2,b,6\n3,c,7\n",
        "Name,Amount\nAlice,5", "id,name\n1,Ann", "1000001,R17,01/02/2024\n1000002,E10,01/03/2024",
        "id;amount;description\n1;1.234,56;Invoice\n2;12,34;Refund\n3;(5,00);Chargeback\n",
    ])
    assert (pre.delimiter, pre.modal, pre.header.ln, pre.stripped) == (",", 3, 2, True)
    assert {s.ln: round(s.score, 2) for s in pre.scored} == {0: 2.5, 2: 5.8, 3: -0.05, 4: -0.05, 5: -0.05}
    assert round(pre.header.gap, 2) == 3.3 and pre.synthetic is None
    assert title.synthetic == ["col_1", "col_2"]
    assert low.synthetic is None
    assert none.synthetic == ["col_1", "col_2", "col_3"]
    assert euro.delimiter == ";"
    assert "Header detected on line 3; removed 2 preamble line(s)." in pre.header_log
