"""Text expressions: decoding, lines, records and fields.

All of them are built-in column expressions, so they stay in the JVM and can
be applied to any string column.  A string column may hold a whole small file
(one row per file); the `*_records` expressions cut it in place, without
exploding and shuffling its lines.  Files too large for a row go through
``operators.records`` instead, which gives the same records.

The patterns use possessive quantifiers: they never backtrack and never
recurse, so a very long quoted field costs one linear pass.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit_or_col(d) -> Column:
    """A delimiter given as a Python string is a literal, not a column name."""
    return F.lit(d) if isinstance(d, str) else d


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.btrim(_col(c), F.lit(K.WHITESPACE))


def is_blank(c) -> Column:
    return strip(c) == F.lit("")


def collapse_whitespace(c) -> Column:
    """Turn every whitespace run into one space (ends are not trimmed)."""
    return F.regexp_replace(_col(c), r"(?U)[\s\x{1c}-\x{1f}]+", " ")


# --------------------------------------------------------------------------
# Encoding and line ends
# --------------------------------------------------------------------------

def latin1_text(raw) -> Column:
    """Bytes as text, one character per byte; never fails."""
    return F.decode(_col(raw).cast("binary"), "ISO-8859-1")


def has_cp1252_undefined(raw) -> Column:
    l1 = latin1_text(raw)
    return reduce(or_, [F.contains(l1, F.lit(u)) for u in K.CP1252_UNDEFINED])


def encoding_label(valid_utf8, undefined, bom) -> Column:
    """Encoding name from whole-file facts (valid UTF-8, undefined bytes, BOM)."""
    return (
        F.when(_col(valid_utf8) & _col(bom), F.lit("utf-8-sig"))
        .when(_col(valid_utf8), F.lit("utf-8"))
        .when(~_col(undefined), F.lit("cp1252"))
        .otherwise(F.lit("latin-1"))
    )


def decode_as(raw, encoding) -> Column:
    """Decode bytes by an encoding label of :func:`encoding_label`."""
    raw, enc = _col(raw), _lit_or_col(encoding)
    l1 = latin1_text(raw)
    return (
        F.when(enc.startswith("utf-8"), raw.cast("binary").cast("string"))
        .when(enc == "cp1252", F.translate(l1, K.CP1252_C1_CHARS, K.CP1252_CHARS))
        .otherwise(l1)
    )


def detect_encoding(raw) -> Column:
    """Encoding label of a binary column that holds one whole file per row."""
    raw = _col(raw)
    return encoding_label(
        F.is_valid_utf8(raw.cast("string")),
        has_cp1252_undefined(raw),
        F.substring(F.hex(raw), 1, 6) == F.lit("EFBBBF"),
    )


def decode_file(raw) -> Column:
    """Detected-encoding text of a whole-file binary column, BOM removed."""
    enc = detect_encoding(raw)
    text = decode_as(raw, enc)
    return F.when(enc == "utf-8-sig", F.substring(text, 2, 2147483647)).otherwise(text)


def normalize_newlines(c) -> Column:
    """CRLF and lone CR become LF."""
    c = _col(c)
    return F.when(F.contains(c, F.lit("\r")), F.regexp_replace(c, "\r\n?", "\n")).otherwise(c)


def newlines_changed(c) -> Column:
    return F.contains(_col(c), F.lit("\r"))


def _without_empty_tail(parts: Column) -> Column:
    return let(parts, lambda p: F.when(F.element_at(p, -1) == F.lit(""), F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def lines(c) -> Column:
    """Lines of a text; a final newline does not open another line."""
    return _without_empty_tail(F.split(_col(c), "\n"))


def count_char(c, ch) -> Column:
    """Occurrences of a one-character string."""
    c = _col(c)
    return F.length(c) - F.length(F.replace(c, _lit_or_col(ch), F.lit("")))


# --------------------------------------------------------------------------
# Records
# --------------------------------------------------------------------------

# A line end closes a record while the number of quotes so far is even.
_PARITY_RECORD = r'\n((?:[^"\n]++|"[^"]*+(?:"|\z))*+)'


def parity_records(c) -> Column:
    """Split a text into records by quote parity (a final LF opens a last, empty one)."""
    return F.regexp_extract_all(F.concat(F.lit("\n"), _col(c)), F.lit(_PARITY_RECORD), F.lit(1))


def stitch_stats(c) -> Column:
    """physical_lines, logical_lines, stitched_records, max_physical_per_record."""
    phys = F.transform(parity_records(c), lambda r: count_char(r, "\n") + 1)
    return let(phys, lambda p: F.struct(
        F.aggregate(p, F.lit(0).cast("bigint"), lambda a, n: a + n).alias("physical_lines"),
        F.size(p).cast("bigint").alias("logical_lines"),
        F.size(F.filter(p, lambda n: n > 1)).cast("bigint").alias("stitched_records"),
        F.array_max(p).cast("bigint").alias("max_physical_per_record"),
    ))


def _escaped(delimiter) -> Column:
    return F.concat(F.lit("\\"), _lit_or_col(delimiter))


def _field_pattern(delimiter, stop: str = "") -> Column:
    """One raw field: quoted with optional tail, or anything up to the delimiter."""
    d = _escaped(delimiter)
    return F.concat(
        F.lit('(?:"[^"]*+(?:""[^"]*+)*+(?:"[^'), d, F.lit(stop + r']*+|\z)|[^'), d, F.lit(stop + "]*+)")
    )


def csv_records(c, delimiter) -> Column:
    """Split a text into records the way a lenient CSV reader does.

    Only a quote that starts a field opens it, and a line end inside an open
    field belongs to the record.  A final newline opens no further record.
    """
    d, field = _escaped(delimiter), _field_pattern(delimiter, "\\n")
    pattern = F.concat(F.lit("\\n("), field, F.lit("(?:"), d, field, F.lit(")*+)"))
    return _without_empty_tail(F.regexp_extract_all(F.concat(F.lit("\n"), _col(c)), pattern, F.lit(1)))


# --------------------------------------------------------------------------
# Fields
# --------------------------------------------------------------------------

_QUOTED_HEAD = r'^"([^"]*+(?:""[^"]*+)*+)'
_QUOTED_ALL = r'^"[^"]*+(?:""[^"]*+)*+"?'


def raw_fields(record, delimiter) -> Column:
    """Fields of one record before unquoting."""
    pattern = F.concat(_escaped(delimiter), F.lit("("), _field_pattern(delimiter), F.lit(")"))
    return F.regexp_extract_all(F.concat(_lit_or_col(delimiter), _col(record)), pattern, F.lit(1))


def unquote(field) -> Column:
    x = _col(field)
    return F.when(
        F.startswith(x, F.lit('"')),
        F.concat(
            F.replace(F.regexp_extract(x, _QUOTED_HEAD, 1), F.lit('""'), F.lit('"')),
            F.regexp_replace(x, _QUOTED_ALL, ""),
        ),
    ).otherwise(x)


def fields(record, delimiter) -> Column:
    """Quote-aware fields of one record; an empty record has no fields.

    Records without a quote, the common case, are split on the delimiter.
    """
    record = _col(record)
    plain = F.split(record, _escaped(delimiter) if not isinstance(delimiter, str) else F.lit("\\" + delimiter))
    quoted = F.transform(raw_fields(record, delimiter), unquote)
    return (
        F.when(record == F.lit(""), F.array().cast("array<string>"))
        .when(F.contains(record, F.lit('"')), quoted)
        .otherwise(plain)
    )


def ends_open(record, delimiter) -> Column:
    """True when the last field of the record is a quoted field still open."""
    last = F.element_at(raw_fields(record, delimiter), -1)
    return last.rlike(r'\A"[^"]*+(?:""[^"]*+)*+\z')


def conform(fields_col, width) -> Column:
    """Cut or pad (with empty strings) a field list to a width."""
    f, n = _col(fields_col), width if isinstance(width, Column) else F.lit(width)
    n = n.cast("int")
    return (
        F.when(F.size(f) == n, f)
        .when(F.size(f) > n, F.slice(f, F.lit(1), n))
        .otherwise(F.concat(f, F.array_repeat(F.lit(""), n - F.size(f))))
    )


def may_need_strip(record) -> Column:
    """False when no cell of a raw record can start or end with whitespace.

    Cells start after the record's start, a delimiter or a quote, and end
    before one; so whitespace next to none of these leaves the cells as they are.
    """
    edge, space = '[,;\\t|"]', r"[\s\x{1c}-\x{1f}]"
    return _col(record).rlike(rf"(?U)(?:\A|{edge}){space}|{space}(?:{edge}|\z)")


def strip_cells(cells, record=None) -> Column:
    """Strip every cell; with the raw record given, clean rows are passed through."""
    stripped = F.transform(_col(cells), strip)
    return stripped if record is None else F.when(may_need_strip(record), stripped).otherwise(_col(cells))


def render_row(fields_col, delimiter) -> Column:
    """One output line: cells quoted only when needed, quotes doubled.

    A single empty cell is written as ``""`` so that the row is not an empty
    line.  Rows in which no cell needs quotes, the common case, are only joined.
    """
    f, d = _col(fields_col), _lit_or_col(delimiter)

    def cell(x):
        need = reduce(or_, [F.contains(x, c) for c in (d, F.lit('"'), F.lit("\n"), F.lit("\r"))])
        quoted = F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(x.isNull(), F.lit("")).when(need, quoted).otherwise(x)

    # concat_ws skips nulls, so a null cell also makes the separator count differ.
    joined = F.call_function("concat_ws", d, f)
    plain = (count_char(joined, d) == F.size(f) - 1) & ~reduce(
        or_, [F.contains(joined, F.lit(c)) for c in ('"', "\n", "\r")])
    line = F.when(plain, joined).otherwise(F.call_function("concat_ws", d, F.transform(f, cell)))
    return F.when((F.size(f) == 1) & (line == F.lit("")), F.lit('""')).otherwise(line)
