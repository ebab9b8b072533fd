"""Fill-in-the-middle: texts cut into prefix, middle and suffix, rotated in place, and restored exactly.

Method: a text is cut into units (lines, ``[^\\n]*\\n|[^\\n]+``).  Two unit
boundaries are drawn from the SHA-256 of ``<seed>:<doc_id>``; the text goes
into a ``bytearray`` with the sentinels inserted at the cuts
(``<P>`` prefix ``<M>`` middle ``<S>`` suffix), and the segments are exchanged
by rotations, each made of three reversals:

* psm: the block ``<M>middle<S>suffix`` is rotated to ``<S>suffix<M>middle``;
* spm: the whole buffer is rotated to ``<S>suffix<P>prefix<M>middle``.

``restore`` finds the sentinels in an output, applies the inverse rotation
(the same three reversals with the other length) and removes them, which
gives the text back byte for byte.

Work is per row, in Arrow batches of pandas UDFs: no shuffle, no state, so a
hot source or a lost executor changes nothing.

Defined cases:

* null text: empty; an empty text has ``n = 0`` and stays plain.
* a text holding a sentinel stays plain (its output could not be told apart).
* null ``doc_id``: no key to draw cuts from, the text stays plain.
* very long texts: one linear pass of reversals over the bytes, no copy per unit.
* ties, repeated rows: the cuts depend on ``doc_id`` alone, so equal rows get equal outputs.
* empty tables: no rows.  Extra columns pass through; the columns made here
  (``fim_*``) replace any of the same name.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StringType, StructField, StructType

# fixed values of the contract: sentinels, key prefix, rates in percent
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
FIM_RATE = 100
SPM_RATE = 50

OUT = StructType([StructField("form", StringType()), StructField("n", LongType()), StructField("prefix_chars", LongType()),
                  StructField("middle_chars", LongType()), StructField("output", StringType())])


def units(text: str) -> list[str]:
    """Lines with their newline; a last line without one counts as well."""
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def draws(doc_id: int, seed: int = SEED) -> list[int]:
    """h1 to h4: the first four 8-digit groups of the hex SHA-256 of ``<seed>:<doc_id>``."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]


def _reverse(buf: bytearray, start: int, end: int) -> None:
    buf[start:end] = buf[start:end][::-1]


def rotate(buf: bytearray, start: int, cut: int, end: int) -> None:
    """Exchange ``buf[start:cut]`` and ``buf[cut:end]`` in place by three reversals."""
    _reverse(buf, start, cut)
    _reverse(buf, cut, end)
    _reverse(buf, start, end)


def transform(text: str | None, doc_id: int | None, seed: int = SEED, fim_rate: int = FIM_RATE,
              spm_rate: int = SPM_RATE) -> tuple[str, int, int | None, int | None, str]:
    """(form, n, prefix_chars, middle_chars, output) of one text."""
    text = text or ""
    pieces = units(text)
    n = len(pieces)
    plain = (not text or doc_id is None or PREFIX in text or SUFFIX in text or MIDDLE in text)
    h = None if plain else draws(doc_id, seed)
    if plain or h[2] % 100 >= fim_rate:
        return "plain", n, None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix = "".join(pieces[:a])
    middle = "".join(pieces[a:b])
    pb, mb = len(prefix.encode()), len(middle.encode())
    buf = bytearray(PREFIX.encode())
    buf += text.encode()
    # sentinels at the cuts: <P>prefix<M>middle<S>suffix
    m_at = len(PREFIX) + pb
    buf[m_at:m_at] = MIDDLE.encode()
    s_at = m_at + len(MIDDLE) + mb
    buf[s_at:s_at] = SUFFIX.encode()
    form = "spm" if h[3] % 100 < spm_rate else "psm"
    if form == "psm":
        rotate(buf, m_at, s_at, len(buf))
    else:
        rotate(buf, 0, s_at, len(buf))
    return form, n, len(prefix), len(middle), buf.decode()


def restore(output: str | None, form: str | None) -> str:
    """The text an output was made from: inverse rotation, then the sentinels removed."""
    output = output or ""
    if form not in ("psm", "spm"):
        return output
    buf = bytearray(output.encode())
    # the text holds no sentinel and none can form across a cut, so the first of each is the one inserted
    p, s, m = (bytes(buf).index(x.encode()) for x in (PREFIX, SUFFIX, MIDDLE))
    k = len(PREFIX)
    if form == "psm":
        # <P>prefix | <S>suffix | <M>middle  ->  <P>prefix <M>middle <S>suffix
        pre, mid = s - k, len(buf) - m - k
        rotate(buf, s, m, len(buf))
    else:
        # <S>suffix | <P>prefix<M>middle  ->  <P>prefix<M>middle <S>suffix
        pre, mid = m - p - k, len(buf) - m - k
        rotate(buf, 0, p, len(buf))
    # remove the sentinels where they now stand, last first
    for at in (k + pre + k + mid, k + pre, 0):
        del buf[at:at + k]
    return buf.decode()


@pandas_udf(OUT)
def _transformed(text: pd.Series, doc_id: pd.Series) -> pd.DataFrame:
    rows = [transform(t if isinstance(t, str) else None, None if pd.isna(d) else int(d))
            for t, d in zip(text, doc_id, strict=True)]
    return pd.DataFrame(rows, columns=["form", "n", "prefix_chars", "middle_chars", "output"]).astype(
        {"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})


@pandas_udf(StringType())
def _restored(output: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([restore(o if isinstance(o, str) else None, f if isinstance(f, str) else None)
                      for o, f in zip(output, form, strict=True)])


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``fim_form``, ``fim_n``, ``fim_prefix_chars``, ``fim_middle_chars`` and ``fim_text``."""
    made = _transformed(F.col(text), F.col(doc_id).cast("long"))
    names = ["fim_form", "fim_n", "fim_prefix_chars", "fim_middle_chars", "fim_text"]
    out = docs.drop(*names, "_fim").withColumn("_fim", made)
    return out.select(*[c for c in out.columns if c != "_fim"],
                      *[F.col("_fim")[f].alias(n) for f, n in zip(["form", "n", "prefix_chars", "middle_chars", "output"], names)])


def restored(output: str = "fim_text", form: str = "fim_form") -> Column:
    """The exact text behind an output column and its form."""
    return _restored(F.col(output), F.col(form))
