"""Slots, packing, language identification and the masked model."""

from collections import Counter, defaultdict

import numpy as np

import brute as B
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from mendframe.llm import masked_lm, packing, rank_order, slots
from mendframe.llm.queries import QUERIES
from mendframe.sources.workspace import Workspace

TEXTS = [None, "", "é", "a", "a", "a", "x" * 90_000, "word " * 3000, "😀 tail", *B.noise("abc dé", 200, 1)]


def test_slots(spark):
    ids = [None, None, *range(len(TEXTS) - 3), 3]
    got = B.rows(slots.shard(B.awkward(spark, TEXTS, ids), 5, Workspace(spark), slots=64))
    sizes = Counter((i, 8 + len((t or "").encode()), B.crc((t or "").encode())) for i, t in zip(ids, TEXTS, strict=True))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sizes
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert set(by) <= set(range(5)) and all(sorted(x) == list(range(len(x))) for x in by.values())
    assert len({(r["vslot"], r["shard"]) for r in got}) == len({r["vslot"] for r in got})


def test_slots_query_and_growth(spark, sf):
    got = B.rows(QUERIES["op1_virtual_slots"](spark, sf))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (8 + len(t.encode()), B.crc(t.encode())) for i, t in docs.items()}
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert max(load.values()) <= 1.02 * sum(load.values()) / 24 or max(load.values()) <= max(r["size"] for r in got)
    work = Workspace(spark)
    rows = slots.slot_rows(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    totals = work.save(slots.slot_totals(rows), "totals")
    one = work.save(slots.new_map(totals, 24), "one")
    two = work.save(slots.grown_map(one, totals, 24), "two")
    before, after = ({r.vslot: r.shard for r in m.collect()} for m in (one, two))
    size = {r.vslot: r.bytes for r in totals.collect()}
    assert {r.version for r in two.collect()} == {2} and len(after) == slots.SLOTS
    assert all(b in (a, 24) for a, b in ((before[k], after[k]) for k in before))
    load = [sum(size[k] for k in after if after[k] == s) for s in range(25)]
    assert max(load) < 1.05 * sum(load) / 25 and min(load) > 0.9 * sum(load) / 25
    assert slots.shard(B.awkward(spark, [None]).where("false"), 3, Workspace(spark)).count() == 0


def test_written_shards(spark, tmp_path):
    docs, work = B.awkward(spark, TEXTS, extra=False), Workspace(spark)
    want = Counter(r["shard"] for r in B.rows(slots.shard(docs, 4, work)))
    slots.write_shards(docs, 4, work, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert Counter(r.shard for r in back.collect()) == want
    assert Counter(r.text for r in back.collect()) == Counter(TEXTS)


def official():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet=" \t\n\x0b\x1c\x85  'sStd1é<|endoftext|>", max_size=60))
def test_ids_are_those_of_the_tokenizer(text):
    global TOKENIZER
    if "TOKENIZER" not in globals():
        TOKENIZER = official()
    coder = packing.encoding(packing.default_vocabulary(), packing.default_added())
    assert coder.encode(text, allowed_special="all") == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_added_token_in_a_text():
    coder = packing.encoding(packing.default_vocabulary(), packing.default_added())
    assert coder.encode("a <|endoftext|> b", allowed_special="all") == [64, 220, 50256, 275]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), min_size=1, max_size=12))
def test_fullest_is_the_best_sum(counts):
    got = packing.fullest(counts, 40)
    top = max(counts)
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n - (length == top) + 1) if s + k * length <= 40 - top}
    assert sum(k * n for k, n in got.items()) == top + max(sums)
    assert got[top] >= 1 and all(0 < n <= counts[k] for k, n in got.items())


@pytest.mark.parametrize("source", ["awkward", "query"])
def test_packing_round_trip(spark, sf, source):
    size = packing.SIZE if source == "query" else 50
    docs = spark.read.parquet(f"{sf}/documents.parquet") if source == "query" else B.awkward(spark, TEXTS, [None, 1, 1, *range(len(TEXTS) - 3)])
    got = B.rows(QUERIES["op8_bin_slack"](spark, sf) if source == "query" else packing.pack(docs, Workspace(spark), size))
    tokenizer = official()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, (s, n) in enumerate(packing.cut(len(ids), size)):
            want[(r.doc_id, k, s, n, B.crc(np.array(ids[s:s + n], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    assert len(bins) <= -(-sum(r["length"] for r in got) // size) * 1.02 + 1


def test_sequences_hold_the_ids(spark):
    docs = B.awkward(spark, TEXTS)
    packed = Workspace(spark).save(packing.pack(docs, Workspace(spark), 50, keep_ids=True), "packed")
    ids = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert ids[r.sequence_id][r.offset:r.offset + r.length] == r.ids
    assert packing.pack(docs.where("false"), Workspace(spark)).count() == 0


def plain_profile(texts, most):
    counts = Counter()
    for t in texts:
        for g in rank_order.grams(rank_order.code_points(t)) if t and len(rank_order.code_points(t)) else []:
            counts[int(g)] += 1
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][:most]


def test_language_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    out = {r.doc_id: B.crc(str(r.doc_id).encode()) % 4 == 2 for r in docs}
    langs = sorted({r.lang for r in docs if not out[r.doc_id]})
    model = {k: {g: i for i, g in enumerate(plain_profile([r.text for r in docs if r.lang == k and not out[r.doc_id]], 400))} for k in langs}
    got = {r["doc_id"]: r for r in B.rows(QUERIES["op10_rank_order"](spark, sf))}
    assert set(got) == set(out)
    right = 0
    for r in docs:
        own = plain_profile([r.text], 400)
        away = [sum(abs(i - model[k][g]) if g in model[k] else 400 for i, g in enumerate(own)) for k in langs]
        g = got[r.doc_id]
        assert g["held_out"] == out[r.doc_id] and g["lang_pred"] == langs[away.index(min(away))] and 0 <= g["score"] <= 1
        right += g["lang_pred"] == r.lang
    assert right >= 0.97 * len(docs)


def test_grams():
    assert [chr(x) if x < 1 << 21 else x for x in rank_order.grams(rank_order.code_points("1 Ab--"))[:2]] == ["a", "b"]
    assert len(rank_order.grams(rank_order.code_points("Ab c"))) == 3 + 5 + 4  # " ab c "
    assert len(rank_order.code_points("12 ..")) == 0


def test_language_of_awkward_texts(spark):
    texts = ["the cat and the dog", None, "", "123 !!", "ﬀ", "der hund und die katze", "the bird", "x" * 100_000] * 3
    got = B.rows(rank_order.learn_and_identify(B.awkward(spark, texts, [None, *range(23)])))
    assert len(got) == 24 and all(r["lang_pred"] in ("en", "und") and 0 <= r["score"] <= 1 for r in got)
    assert all((r["lang_pred"] == "und") == (texts[r["doc_id"] + 1] in (None, "", "123 !!")) for r in got if r["doc_id"] is not None)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    none = rank_order.learn_and_identify(B.awkward(spark, texts).withColumn("lang", no_lang()))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert rank_order.learn_and_identify(B.awkward(spark, texts).where("false")).count() == 0


def no_lang():
    from pyspark.sql import functions as F

    return F.lit(None).cast("string")


def test_network_learns_the_counts():
    """Where the middle word is the sum of its neighbours, the trained table says so."""
    v = 12
    counts = np.zeros((v, v, v), np.float32)
    for a in range(v):
        for b in range(v):
            counts[a, (a + b) % v, b] = 5
    table = masked_lm.train(counts, rounds=600)
    assert np.allclose(np.exp(table).sum(axis=1), 1, atol=1e-3)
    right = sum(table[a, :, b].argmax() == (a + b) % v for a in range(v) for b in range(v))
    assert right > 0.9 * v * v


def test_scores_of_words_in_order(spark, sf):
    """Shuffled words are less likely; sums are those of the table."""
    import random

    texts = [t for t in B.real_texts(spark, "/root/testdata/sf0.01", 600) if len(t.split()) > 60]
    docs = B.awkward(spark, texts)
    frequent = masked_lm.frequent_words(docs)
    plain = Counter(w for t in texts for w in t.split())
    assert frequent == [w for w, _ in sorted(plain.items(), key=lambda x: (-x[1], x[0]))][:masked_lm.FREQUENT]
    counts = np.zeros(masked_lm.CLASSES ** 3, np.float32)
    for r in masked_lm.cell_counts(docs, frequent).collect():
        counts[r.cell] = r.n
    classes = masked_lm.Classes(frequent)
    assert counts.sum() == sum(plain.values())
    table = masked_lm.train(counts.reshape((masked_lm.CLASSES,) * 3))
    draw = random.Random(1)
    mixed = []
    for t in texts:
        w = t.split()
        draw.shuffle(w)
        mixed.append(" ".join(w))
    straight = {r.doc_id: r.sum_logprob for r in masked_lm.score(docs, frequent, table).collect()}
    shuffled = {r.doc_id: r.sum_logprob for r in masked_lm.score(B.awkward(spark, mixed), frequent, table).collect()}
    assert sum(straight[i] > shuffled[i] for i in straight) > 0.6 * len(straight)
    c = classes.of(texts[0])
    want = sum(float(table[c[i - 1], c[i], c[i + 1]]) for i in range(1, len(c) - 1))
    assert abs(want - straight[0]) < 1e-3 * abs(want)


def test_scores_of_awkward_texts(spark):
    got = {r["doc_id"]: r for r in B.rows(masked_lm.learn_and_score(B.awkward(spark, TEXTS), Workspace(spark)))}
    assert len(got) == len(TEXTS)
    assert got[0]["n_words"] == 0 and got[0]["sum_logprob"] == 0 and got[0]["mean_logprob"] is None
    assert all(np.isfinite(r["sum_logprob"]) for r in got.values())
    assert masked_lm.learn_and_score(B.awkward(spark, TEXTS).where("false"), Workspace(spark)).count() == 0


def test_scores_query(spark, sf):
    got = B.rows(QUERIES["op9_masked_likelihood"](spark, sf))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: r["n_words"] for r in got} == {i: len(t.split()) for i, t in docs.items()}
    assert all(r["sum_logprob"] < 0 for r in got)


def test_rare_words_have_their_own_terms(spark, monkeypatch):
    """A rare word swapped for another of its look changes the score, whether the workers hold it or it is joined."""
    texts = ["the zorbing was long"] * 6 + ["the blorping was long", "the plonking was long"]
    assert masked_lm.look("zorbing") == masked_lm.look("blorping") == masked_lm.look("plonking")
    monkeypatch.setattr(masked_lm, "FREQUENT", 3)
    monkeypatch.setattr(masked_lm, "most_frequent", lambda words, most: ["the", "was", "long"])
    scores = []
    for head in (0, 1, 100):
        monkeypatch.setattr(masked_lm, "HEAD", head)
        got = {r["doc_id"]: r["sum_logprob"] for r in B.rows(masked_lm.learn_and_score(B.awkward(spark, texts), Workspace(spark)))}
        assert got[0] - got[6] == pytest.approx(np.log(6.5 / 1.5)) and got[6] == pytest.approx(got[7])
        scores.append(got[0])
    assert scores == pytest.approx([scores[0]] * 3, rel=1e-4)


def test_word_terms_are_a_distribution(spark):
    texts = ["aaax bbbx aaax cccx", "dddx aaax eeee", None]
    words = masked_lm.in_classes(masked_lm.vocabulary(B.awkward(spark, texts)), [])
    terms, unseen = masked_lm.word_terms(words)
    mass = Counter({i: float(np.exp(x)) for i, x in unseen.items()})
    for r in terms.collect():
        mass[masked_lm.look(r.word)] += float(np.exp(r.logp))
    seen = {masked_lm.look(w) for t in texts if t for w in t.split()}
    assert all(mass[i] == pytest.approx(1) for i in seen)


def test_outer_words_weigh(spark):
    """Where the word two places before decides, the window's weight is above zero and the classes are predicted better."""
    texts = [f"{a} x y {a}" for a in ("u", "v")] * 100
    docs = B.awkward(spark, texts)
    frequent = masked_lm.frequent_words(docs)
    codes = masked_lm.coded(docs, frequent).select("doc_id", "classes")
    counts, pairs = np.zeros(masked_lm.CLASSES ** 3, np.float32), {d: np.zeros(masked_lm.CLASSES ** 2) for d in masked_lm.OUTER}
    for r in masked_lm.counted(codes).collect():
        (counts if r.kind == 1 else pairs[r.kind])[r.cell] = r.n
    assert pairs[3].sum() == 100 * 2 * (4 + 3)
    table = masked_lm.train(counts.reshape((masked_lm.CLASSES,) * 3))
    outer = masked_lm.associations({d: n.reshape(masked_lm.CLASSES, -1) for d, n in pairs.items()})
    weight = masked_lm.fitted(codes, table, outer)
    wide = {d: np.float32(weight[abs(d)]) * x for d, x in outer.items()}
    near, far = (masked_lm.class_terms(codes, table, o).agg({"class_logprob": "sum"}).collect()[0][0] for o in (None, wide))
    assert weight[3] > 0 and far > near + 50


def test_pieces_hold_the_added_token(spark):
    import zlib

    import numpy as np

    df = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pieces(df).collect()}
    assert got == {1: (5, zlib.crc32(np.asarray([64, 220, 50256, 275, 0], "<u4").tobytes())),
                   2: (1, zlib.crc32(np.asarray([0], "<u4").tobytes()))}


def test_vocabulary_cuts_words_as_the_workers_do(spark):
    text = "a\x1cb c d\x85e  f\x1fg"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert sorted(r.word for r in masked_lm.vocabulary(df).collect()) == sorted(text.split())


def test_weights_are_fitted_on_every_position(spark, monkeypatch):
    """The weights are a Newton step over all documents, however many, against a plain one in doubles."""
    monkeypatch.setattr(masked_lm, "FIT_POSITIONS", 40, raising=False)
    held = {}
    for name in ("train", "associations"):
        made = getattr(masked_lm, name)
        monkeypatch.setattr(masked_lm, name, lambda x, name=name, made=made: held.setdefault(name, made(x)))
    fit = masked_lm.fitted
    monkeypatch.setattr(masked_lm, "fitted", lambda *a: held.setdefault("weight", fit(*a)))
    texts = [f"{a} x y {a}" for a in ("u", "v")] * 40 + ["u x v", "y y u v x", None, ""] * 30
    docs = B.awkward(spark, texts).repartition(3)
    masked_lm.learn_and_score(docs, Workspace(spark))
    classes = masked_lm.Classes(masked_lm.frequent_words(docs))
    slope, bend = np.zeros(2), np.zeros((2, 2))
    for text in texts:
        c = [0, 0, *classes.of(text), 0, 0]
        for i in (i for i, x in enumerate(c) if x):
            f = np.array([held["associations"][-d][c[i - d]] + held["associations"][d][c[i + d]] for d in masked_lm.OUTER], np.float64)
            p = np.exp(held["train"][c[i - 1], :, c[i + 1]] + masked_lm.WEIGHT * f.sum(axis=0))
            p /= p.sum()
            slope += f[:, c[i]] - f @ p
            bend += (f * p) @ f.T - np.outer(f @ p, f @ p)
    want = np.clip(masked_lm.WEIGHT + np.linalg.solve(bend + 1e-3 * np.eye(2), slope), 0, 1)
    assert [held["weight"][d] for d in masked_lm.OUTER] == pytest.approx(want, abs=1e-3) and 0 < want[0] + want[1] < 2
