"""Plain versions of what the operators must return, and documents that are awkward for them."""

import hashlib
import random
import re
import zlib

WS = re.compile(r"[^\x20\x09-\x0D]+")

# columns that operators make themselves, with other content
CLASHES = ["size", "vslot", "spans", "words", "_text", "_words", "_row", "score", "length", "node", "key", "kept", "n_words", "component_id"]


def awkward(spark, texts, ids=None, extra=True):
    ids = list(ids if ids is not None else range(len(texts)))
    names = ["doc_id", "text", "lang", "source", "n_chars", *(CLASHES if extra else [])]
    rows = [(i, t, None if k % 7 == 3 else "en", None if k % 5 == 2 else "s", None if t is None else len(t), *(["x"] * len(CLASHES) if extra else []))
            for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    kinds = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in names[5:])
    return spark.createDataFrame(rows, kinds).repartition(3)


def real_texts(spark, sf, n=200):
    return [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(n).collect()]


def rows(df):
    return [r.asDict() for r in df.collect()]


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def spans_of(text, pattern, keep=lambda m: True):
    return [(m.start(), m.end()) for m in re.finditer(pattern, text) if keep(m)]


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def only_digits(s):
    return re.sub("[^0-9]", "", s)


def pii(text):
    text = text or ""
    return {
        "email": spans_of(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        "ip": spans_of(text, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        "card": spans_of(text, r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(only_digits(m[0])) <= 19 and luhn(only_digits(m[0]))),
        "phone": spans_of(text, r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(only_digits(m[0])) <= 15),
    }


def secrets(text):
    text = text or ""
    return {
        "assign": spans_of(text, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        "access": spans_of(text, r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        "hex": spans_of(text, r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    }


def digest(spans, by_start):
    order = list(spans)
    flat = [(s, order.index(k), k, s, e) if by_start else (order.index(k), s, k, s, e) for k, xs in spans.items() for s, e in xs]
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for _, _, k, s, e in sorted(flat)).encode()).hexdigest()


def quality(text):
    text = text or ""
    words = WS.findall(text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if WS.search(line):
            again += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i:i + 5]), []).append(i)
    hit = {j for xs in at.values() if len(xs) > 1 for i in xs for j in range(i, i + 5)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": again, "n_repeat_words": len(hit), "base_failed": len(words) < 10 or 100 * len(hit) > 20 * len(words)}


def shingles(text, k):
    words = WS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def near(texts, k):
    """(set sizes, smallest index reachable)."""
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def norm_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(text, items):
    words, hit, found = norm_words(text), set(), set()
    for item, body in items:
        w = norm_words(body)
        n = min(13, len(w))
        windows = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i:i + n]) in windows:
                found.add(str(item))
                hit.update(range(i, i + n))
    return {"n_words": len(words), "n_hit": len(hit), "n_items": len(found),
            "items_sha256": hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
            "contaminated": len(hit) > 0 and 20 * len(hit) >= len(words)}


def noise(alphabet, n, seed, most=60):
    draw = random.Random(seed)
    return ["".join(draw.choice(alphabet) for _ in range(draw.randrange(most))) for _ in range(n)]


PIECES = ["a@b.co", "a@b", "x.y+z@m-1.example.com", "@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "0001.2.3.004", "+1 (555) 123-4567", "+12", "+1-", "4111 1111 1111 1111",
          "4111111111111111", "4111111111111112", "4111-1111 1111-1111", "12 34", "9" * 40, " ", "\n", "é", "😀", ".", "-", "_", "call", "555 123 4567", "email: joe [at] site [dot] com"]
SECRET_PIECES = ["password=", "Token: \"", "api_key = ", "APIKEY:'", "secret", "tOkEn", ":", "=", "\"", "abcdefghijkl", "short", "AKIA", "AKIAABCDEFGHIJ1234", "0123456789abcdef",
                 "deadbeef", "ABCDEF", " ", "\n", "é", "😀", "aB3dE5fG7hJ9kL1mN3", "_-/+=."]


def mixed(pieces, n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(pieces) for _ in range(draw.randrange(1, 14))) for _ in range(n)]


__all__ = [n for n in dir() if not n.startswith("_")]
