"""Personal data, secrets and quality rules against plain versions."""

import pytest

import brute as B
from mendframe.llm import private_data, quality_rules, secret_scan
from mendframe.llm.queries import QUERIES
from mendframe.sources.workspace import Workspace

LONG = "ab" * 60_000


def check_spans(got, text, want, by_start):
    kinds = list(want)
    assert [got[f"n_{k}"] for k in kinds] == [len(want[k]) for k in kinds], text[:300]
    assert got["base_sha256"] == B.digest(want, by_start), text[:300]
    listed = [x.split(":") for x in got["spans"].split(",") if x]
    for k in kinds:
        for s, e in want[k]:
            assert [k, str(s), str(e)] in listed


@pytest.mark.parametrize("op, plain, by_start, pieces", [
    (private_data, B.pii, False, B.PIECES), (secret_scan, B.secrets, True, B.SECRET_PIECES)])
def test_spans_of_awkward_texts(spark, op, plain, by_start, pieces):
    texts = [None, "", " ", LONG, LONG + " a@b.cc", *B.mixed(pieces, 400, 1), *pieces, *pieces,
             *B.noise("ab1.@+- (", 100, 2), "token=password=abcdefghijklmnop", "secret: token: abcdefghijklmn"]
    got = B.rows(op.find(B.awkward(spark, texts), Workspace(spark)))
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["doc_id"]] or ""
        check_spans(r, t, plain(t), by_start)


@pytest.mark.parametrize("op", [private_data, secret_scan])
def test_no_rows(spark, op):
    assert op.find(B.awkward(spark, [None]).where("false"), Workspace(spark)).count() == 0


@pytest.mark.parametrize("name, plain, by_start", [("op3_weak_supervision", B.pii, False), ("op6_markov_secrets", B.secrets, True)])
def test_span_queries(spark, sf, name, plain, by_start):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = B.rows(QUERIES[name](spark, sf))
    assert len(got) == len(texts)
    for r in got:
        check_spans(r, texts[r["doc_id"]], plain(texts[r["doc_id"]]), by_start)


def test_labelers_are_told_apart():
    """Votes drawn from known reliabilities: the estimate ranks the labelers and finds the classes."""
    import random

    draw, counts, truth = random.Random(3), {}, {}
    right = [0.95, 0.9, 0.8, 0.6]
    for _ in range(20_000):
        c = draw.random() < 0.4
        p = 0
        for r in right:
            v = 1 if draw.random() < 0.2 else (2 if (draw.random() < r) == c else 0)
            p = p * 3 + v
        counts[p] = counts.get(p, 0) + 1
        yes, n = truth.get(p, (0, 0))
        truth[p] = (yes + c, n + 1)
    post, says = private_data.reliabilities(counts)
    found = [(says[j][1][2] / (says[j][1][2] + says[j][1][0])) for j in range(4)]
    assert all(abs(a - b) < 0.05 for a, b in zip(found, right, strict=True))
    wrong = sum(n - yes if post[p] > 0.5 else yes for p, (yes, n) in truth.items())
    assert wrong / 20_000 < 0.1


def test_loose_spans_are_added_and_kept_apart(spark):
    texts = ["mail me: joe [at] site [dot] com now", "call me at (555) 123-4567 today", "a@b.com and +1 555 123 4567", "plain words only"] * 20
    got = B.rows(private_data.find(B.awkward(spark, texts), Workspace(spark)))
    listed = {r["doc_id"] % 4: r["spans"] for r in got}
    assert listed[0].startswith("email:") and listed[1].startswith("phone:") and listed[3] == ""
    for r in got:
        spans = sorted((x["s"], x["e"], x["base"]) for x in r["found"])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False) if not (a[2] and b[2]))


def test_random_tokens_are_told_from_identifiers(spark):
    import random

    draw, hexes = random.Random(5), "0123456789abcdef"
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    values = ["".join(draw.choice(letters) for _ in range(32)) for _ in range(300)]
    words = ["connection", "timeout", "maximum", "retries", "customer", "repository", "container", "interface", "response", "handler"]
    names = ["_".join(draw.choice(words) for _ in range(3)) + "_2" for _ in range(300)]
    texts = [f"password = {v} {' '.join(words)}" for v in values[:150]] + [f"see {v} there" for v in values[150:]]
    texts += [f"call {n} with {' '.join(words)}" for n in names] + ["".join(draw.choice(hexes) for _ in range(40))]
    got = {r["doc_id"]: r for r in B.rows(secret_scan.find(B.awkward(spark, texts), Workspace(spark)))}
    caught = sum("random" in got[i]["spans"] for i in range(150, 300))
    false = sum("random" in got[i]["spans"] for i in range(300, 600))
    assert caught >= 145 and false <= 5


def test_redaction(spark):
    texts = ["x token = abcdefghijklmnop y", "é deadbeefdeadbeef", "clean", None, "", "password=0123456789abcdef0123456789abcdef."]
    docs = B.awkward(spark, texts)
    got = {r["doc_id"]: r for r in B.rows(secret_scan.redacted(docs, Workspace(spark)))}
    assert [got[i]["text"] for i in range(6)] == ["x [SECRET] y", "é [SECRET]", "clean", None, "", "[SECRET]"]
    assert list(got[0]) == docs.columns
    assert [got[i]["n_chars"] for i in range(4)] == [12, 10, 5, None]


def test_quality_counts(spark, sf):
    texts = [None, "", " \t\x0b", "a b c d e " * 3, "x\ny\nx\n\n \nx", "a b c d", LONG, "a b " * 20_000, *B.noise("ab \n#", 300, 4), *B.real_texts(spark, sf)]
    docs = B.awkward(spark, texts)
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = B.rows(quality_rules.judged(docs, labels, Workspace(spark)))
    assert len(got) == len(texts)
    for r in got:
        want = B.quality(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want, texts[r["doc_id"]][:200]
        assert r["kept"] == (not want["base_failed"])  # no labels, no rules
    assert quality_rules.judged(docs.where("false"), labels.where("false"), Workspace(spark)).count() == 0


def test_rules_on_held_out_labels(spark):
    """Learned on half of the labels, judged on the other half."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r["kept"] for r in B.rows(quality_rules.judged(docs, labels.where("doc_id % 2 = 0"), Workspace(spark)))}
    held = labels.where("doc_id % 2 = 1").collect()
    good = [got[r.doc_id] for r in held if r.quality == 1]
    bad = [got[r.doc_id] for r in held if r.quality == 0]
    assert sum(good) >= 0.98 * len(good)
    assert sum(bad) <= 0.4 * len(bad)


def test_kept_documents_are_unchanged(spark, sf):
    texts = B.real_texts(spark, sf) + ["too short", None]
    docs = B.awkward(spark, texts)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = quality_rules.kept_documents(docs, labels, Workspace(spark))
    judged = {r["doc_id"] for r in B.rows(quality_rules.judged(docs, labels, Workspace(spark))) if r["kept"]}
    assert kept.columns == docs.columns
    assert {r.doc_id: r.text for r in kept.collect()} == {i: texts[i] for i in judged}


def test_random_tokens_without_digits_short_and_around_strict_spans(spark):
    import random
    import string

    draw, hexes = random.Random(6), "0123456789abcdef"
    make = lambda n, of=string.ascii_letters + string.digits: "".join(draw.choice(of) for _ in range(n))
    words = ["connection", "timeout", "maximum", "retries", "customer", "repository", "container", "interface", "response", "handler"]
    texts = [f"password = {make(32)} {' '.join(words)} {'_'.join(draw.sample(words, 3))}_2 {words[i % 10]}{i}" for i in range(300)]
    letters = [f"see {make(24, string.ascii_letters)} there" for _ in range(20)]
    short = [f"see {make(14)} there" for _ in range(20)]
    names = [f"see {''.join(draw.sample(words, 2))}{i} there {'_'.join(draw.sample(words, 2))}_{i}" for i in range(20)]
    around = [f"see {make(20)}G{make(20, hexes)}Z{make(5)} there" for _ in range(20)]
    docs = B.awkward(spark, texts + letters + short + names + around)
    got = {r["doc_id"]: r["spans"] for r in B.rows(secret_scan.find(docs, Workspace(spark)))}
    caught = [sum("random" in got[300 + 20 * k + i] for i in range(20)) for k in range(4)]
    assert caught[0] >= 14 and caught[1] >= 14 and caught[2] <= 1 and caught[3] >= 19, caught
    clean = {r["doc_id"]: r["text"] for r in B.rows(secret_scan.redacted(docs, Workspace(spark)))}
    assert sum(set(clean[i].replace("[SECRET]", "")) <= set("see there") for i in range(360, 380)) >= 18
    path = B.rows(secret_scan.find(B.awkward(spark, [*texts, "see commit/deadbeefdeadbeef there"]), Workspace(spark)))
    assert [r["spans"] for r in path if r["doc_id"] == 300] == ["hex:11:27"]
