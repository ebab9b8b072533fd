"""Near copies, benchmark overlaps and quotes against plain versions, and the pipeline."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

import brute as B
import corpus_pipeline
import pytest
from mendframe.llm import near_copies, quote_links, winnowing
from mendframe.llm.components import components
from mendframe.llm.queries import QUERIES
from mendframe.sources.workspace import Workspace


def copies(seed=1, groups=12, each=8):
    """Texts around the threshold: each has some words of its group's text changed."""
    draw, out = random.Random(seed), []
    for _ in range(groups):
        base = ["".join(draw.choice("abcdeé") for _ in range(4)) for _ in range(draw.choice([3, 12, 40, 120]))]
        for _ in range(each):
            w = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 4, 8])):
                w[draw.randrange(len(w))] = "".join(draw.choice("xyz") for _ in range(5))
            out.append(draw.choice([" ", "\n", "\t "]).join(w) if draw.random() < 0.7 else " ".join(w).upper().replace("É", "é"))
    return out


AWKWARD = [None, "", "  \n", "one", "ONE", "one two", "One  Two", "é É", "a b a b a b a b", "w " * 30_000, "w " * 30_001]


def check_components(got, texts, ids, k):
    sizes, roots = B.near(texts, k)
    for r, i in zip(sorted(got, key=lambda r: r["doc_id"]), range(len(texts)), strict=True):
        want = ids[i] if not sizes[i] else min(ids[j] for j in range(len(texts)) if roots[j] == roots[i])
        assert (r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) == (ids[i], sizes[i], want, ids[i] == want), texts[i]


@pytest.mark.parametrize("k", [2, 5])
def test_components_of_awkward_texts(spark, k):
    texts = [*AWKWARD, *copies(), *copies(2)[:40]]
    ids = [7 * i + 3 for i in range(len(texts))]
    check_components(B.rows(near_copies.components_of(B.awkward(spark, texts, ids), k, Workspace(spark))), texts, ids, k)


def test_components_in_blocks(spark, monkeypatch):
    """Buckets over the block size go another way with the same result."""
    monkeypatch.setattr(near_copies, "BLOCK", 3)
    texts = copies(5, 10, 14)
    check_components(B.rows(near_copies.components_of(B.awkward(spark, texts), 2, Workspace(spark))), texts, list(range(len(texts))), 2)


def test_components_without_ids(spark):
    texts = ["a b c d", "a b c d", "e f g", None, "e f g", "x y"]
    got = B.rows(near_copies.components_of(B.awkward(spark, texts, [None, 5, None, None, None, 9]), 2, Workspace(spark)))
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in got) == Counter(
        {(None, 5, False): 1, (5, 5, True): 1, (None, None, True): 3, (9, 9, True): 1})
    assert near_copies.components_of(B.awkward(spark, texts).where("false"), 2, Workspace(spark)).count() == 0
    left = near_copies.without_copies(B.awkward(spark, [*texts, "x y", "x y"], [None, 5, None, None, None, 9, 9, 10]), 2, Workspace(spark))
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, ""), (0, "e f g"), (5, "a b c d"), (9, "x y")]


def test_components_query(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    check_components(B.rows(QUERIES["op4_similarity_sketch"](spark, sf)), [t for _, t in docs], [i for i, _ in docs], 2)


def test_sketches_estimate_similarity():
    draw = np.random.default_rng(1)
    for size in (1, 2, 7, 50, 3000):
        common, own = draw.integers(1, 1 << 62, size).astype(np.uint64), [draw.integers(1, 1 << 62, size // 4).astype(np.uint64) for _ in range(2)]
        a, b = (np.unique(np.concatenate([common, o])) for o in own)
        sk = near_copies.sketches([a, b])
        assert (sk != near_copies.EMPTY).all()
        want = size / (size + 2 * (size // 4))
        assert abs((sk[0] == sk[1]).mean() - want) < 0.15


def test_contraction(spark):
    draw = random.Random(4)
    links = [(i, i + 1) for i in range(200)] + [(300 + draw.randrange(60), 300 + draw.randrange(60)) for _ in range(40)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    root = {x: x for ab in links for x in ab}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    order = list(root)
    got = components(spark.createDataFrame(links, "a long, b long"), Workspace(spark), "t")
    assert {r.node: r.root for r in got.collect()} == {i: find(i) for i in order}
    assert components(spark.createDataFrame([], "a long, b long"), Workspace(spark), "t").count() == 0


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"), (2, "short item"), (3, None), (4, "--"), (5, "One two three Four five six seven"),
         (None, "nameless item with words"), (6, "short item"), (7, "é ü ß"), (8, "a a a a a a a a a a a a a a a a a a")]


def test_overlaps_of_awkward_texts(spark):
    draw = random.Random(2)
    vocabulary = " ".join(t for _, t in ITEMS if t).split()
    texts = [None, "", "...", "Short, ITEM", "short items", "a " * 40_000, "x " * 50_000 + "É ü ß é ü ß"]
    for _ in range(200):
        parts = []
        for _ in range(draw.randrange(1, 6)):
            w = (draw.choice(ITEMS)[1] or "").split()
            lo = draw.randrange(len(w) + 1)
            parts.append(draw.choice([" ", ", ", "\n", "--"]).join(w[lo:lo + draw.choice([3, 12, 13, 14, 20])] if draw.random() < 0.8 else draw.choices(vocabulary, k=5)))
        texts.append(" ".join(parts))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = B.rows(winnowing.overlaps(B.awkward(spark, texts + texts[3:9]), items, Workspace(spark)))
    assert len(got) == len(texts) + 6
    for r in got:
        t = (texts + texts[3:9])[r["doc_id"]]
        # an item without an id counts for hits only
        want = B.contamination(t, ITEMS)
        named = B.contamination(t, [x for x in ITEMS if x[0] is not None])
        want |= {k: named[k] for k in ("n_items", "items_sha256")}
        assert {k: r[k] for k in want} == want, t
    none = winnowing.overlaps(B.awkward(spark, texts[:6]), items.where("false"), Workspace(spark))
    assert {(r.n_hit, r.n_items, r.contaminated) for r in none.collect()} == {(0, 0, False)}
    assert winnowing.overlaps(B.awkward(spark, texts).where("false"), items, Workspace(spark)).count() == 0


def test_overlaps_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = B.rows(QUERIES["op7_winnowing"](spark, sf))
    assert len(got) == len(docs) and any(r["contaminated"] for r in got)
    for r in got:
        want = B.contamination(docs[r["doc_id"]], items)
        assert {k: r[k] for k in want} == want


def test_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = winnowing.clean_documents(docs, spark.createDataFrame(items, "item_id long, text string"), Workspace(spark))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect() if not B.contamination(r.text, items)["contaminated"]}


def plain_mail(text):
    """(own text, [(level, normalised paragraph)])."""
    out, level, buf, own = [], 0, [], []
    for line in re.split(r"\r?\n", text or "") + [""]:
        m = re.match(r"^(?:[ \t]?>)+[ \t]?", line)
        marks = m[0] if m else ""
        n, rest = marks.count(">"), line[len(marks):]
        if n == 0 and not re.match(r"^On .{1,200} wrote:\s*$", rest):
            own.append(rest)
        if not rest.strip(" ") or n != level:
            if buf:
                out.append((level, "\n".join(buf)))
            buf = []
        if rest.strip(" "):
            buf.append(rest)
        level = n
    if buf:
        out.append((level, "\n".join(buf)))
    out = [(n, re.sub(r"\s+", " ", p, flags=re.A).strip(" ").lower()) for n, p in out if not (n == 0 and re.match(r"^On .{1,200} wrote:\s*$", p))]
    return "\n".join(own[:-1]).strip("\n"), out


def plain_links(mails):
    """message_id -> parent, from (scope, id, position, text) without nulls."""
    first, parent = {}, {}
    parsed = [(s, i, p, plain_mail(t)) for s, i, p, t in mails]
    for s, i, p, (_, parts) in parsed:
        for level, x in parts:
            if level == 0:
                first[s, x] = min(first.get((s, x), (p, i)), (p, i))
    for s, i, p, (_, parts) in parsed:
        found = [(-level, *first[s, x]) for level, x in parts if level and (s, x) in first and first[s, x][0] < p and first[s, x][1] != i]
        if found:
            parent[i] = max(found + ([parent[i, "best"]] if (i, "best") in parent else []))[2]
            parent[i, "best"] = max(found + ([parent[i, "best"]] if (i, "best") in parent else []))
    return {k: v for k, v in parent.items() if not isinstance(k, tuple)}


def check_conversations(got, mails):
    parent = plain_links(mails)
    own = Counter((i, plain_mail(t)[0]) for _, i, _, t in mails)
    assert Counter((r["message_id"], r["text"]) for r in got) == own
    assert {r["message_id"]: r["parent_id"] for r in got if r["parent_id"]} == parent
    threads = defaultdict(list)
    for r in got:
        threads[r["conversation_id"]].append(r)
    place = {r["message_id"]: (r["conversation_id"], r["place"]) for r in got}
    for rs in threads.values():
        assert sorted(r["place"] for r in rs) == list(range(len(rs)))
    for child, p in parent.items():
        assert place[child][0] == place[p][0] and place[child][1] > place[p][1]
    roots = {c for c in place if c not in parent}
    assert len(threads) == len(roots) or len(threads) <= len(roots)


def test_quotes(spark):
    mails = [
        ("s", "m1", 1, "Hello all\n\nSecond thought"), ("s", "m2", 2, "On Monday X wrote:\n> Hello   ALL\n\nAgreed."),
        ("s", "m3", 3, ">> hello all\n> Agreed.\n\nMe too"), ("s", "m4", 4, "> second thought\nYes"), ("s", "m5", 5, "> never said\nLost"),
        ("t", "n1", 1, "Hello all"), ("t", "n2", 2, "> Me too\nother scope"), ("s", "m0", 0, "> Me too\nquotes the future"), ("s", "m6", 6, ""),
        ("s", "m7", 7, "> > > deep\n> > Yes\n"), ("s", "m7", 7, "> > > deep\n> > Yes\n"), ("u", "u1", 1, None),
    ]
    docs = spark.createDataFrame([(*m, "user", "x") for m in mails], "scope string, message_id string, position long, text string, role string, place string")
    got = B.rows(quote_links.conversations(docs, Workspace(spark)))
    check_conversations(got, mails)
    answers = {r["message_id"]: r["parent_id"] for r in got}
    assert answers == {"m1": None, "m2": "m1", "m3": "m2", "m4": "m1", "m5": None, "n1": None, "n2": None, "m0": None, "m6": None, "m7": "m4", "u1": None}
    assert quote_links.conversations(docs.where("false"), Workspace(spark)).count() == 0
    ring = spark.createDataFrame([("s", "m", 1, "first"), ("s", "n", 3, "> first\nsecond"), ("s", "m", 5, "> second\nthird")], "scope string, message_id string, position long, text string").selectExpr("*", "'user' AS role")
    assert {r.message_id: r.parent_id for r in quote_links.conversations(ring, Workspace(spark)).collect()} == {"m": None, "n": "m"}
    nulls = docs.selectExpr("cast(null as string) scope", "if(message_id = 'm1', null, message_id) message_id", "if(message_id = 'm2', null, position) position", "text", "cast(null as string) role")
    assert quote_links.conversations(nulls, Workspace(spark)).count() == len(mails)


def test_quotes_query(spark, sf):
    """Mails made of chats: the links give back which turn answers which."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    mails = [(r.scope, r.message_id, r.position, r.text) for r in quote_links.as_mails(turns).collect()]
    got = B.rows(QUERIES["op2_quote_links"](spark, sf))
    check_conversations(got, mails)
    back = sum(r["parent_id"] == f"{r['scope']}:{int(r['message_id'].split(':')[1]) - 1}" for r in got if r["parent_id"])
    assert back >= 0.95 * sum(bool(r["parent_id"]) for r in got) > 0
    assert Counter((r["scope"], r["text"]) for r in got) == Counter((r.conv_id, r.text.strip("\n")) for r in turns.collect())


def test_pipeline(spark, sf):
    """Every stage against its plain version on what the stage before it kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, docs
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = Workspace(spark).save(stage(spark, kept, sf), "stage")
        after = {r.doc_id: getattr(r, "text", None) for r in kept.collect()}
        if name == "quality_rules":
            assert not any(B.quality(t)["base_failed"] for t in after.values())
            assert len(after) > 0.75 * len(before)
        elif name == "near_duplicates":
            ids = sorted(before)
            _, roots = B.near([before[i] for i in ids], 5)
            assert set(after) == {ids[r] for r in roots}
        elif name == "decontamination":
            assert set(after) == {i for i, t in before.items() if not B.contamination(t, items)["contaminated"]}
        elif name == "secret_scans":
            assert set(after) == set(before)
            assert not any(any(B.secrets(t).values()) for t in after.values())
            assert all(after[i] == t for i, t in before.items() if not any(B.secrets(t).values()) and "[SECRET]" not in after[i])
        else:
            assert set(after) == set(before)
            break
        assert kept.columns == columns
    whole = corpus_pipeline.run(spark, sf)
    assert Counter(map(tuple, whole.drop("sequence_id", "offset").collect())) == Counter(map(tuple, kept.drop("sequence_id", "offset").collect()))


def test_pipeline_of_awkward_tables(spark, tmp_path):
    texts = [None, "", "too short", *B.real_texts(spark, "/root/testdata/sf0.001", 40), *copies()[:20]]
    d = str(tmp_path)
    B.awkward(spark, texts + texts[-3:], [None, *range(len(texts) + 2)]).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(None, None, None), (3, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(None, None), (1, texts[4])], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() > 0
    spark.read.parquet(f"{d}/documents.parquet").where("false").write.parquet(f"{d}/e/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").where("false").write.parquet(f"{d}/e/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{d}/e").count() == 0
