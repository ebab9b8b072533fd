"""Queries over the structure of files: delimiter, header, preamble."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import detect as D
from ..functions.text import fields
from ..operators import profile as P
from . import inputs as I
from .registry import query

# --- delimiter -------------------------------------------------------------------

_BASE = f"""WITH {I.FILES}, {I.SAMPLE}, {I.CANDIDATES}"""
_LEGACY = (f"WITH {I.FILES}, {I.SAMPLE}, {I.CANDIDATES}"
           .replace("16384", str(K.LEGACY_SAMPLE_CHARS)).replace("i <= 30", f"i <= {K.LEGACY_SAMPLE_LINES}"))


def _thresholds() -> str:
    level, cases, i = 1.0, [], 0
    while level >= 0.9:
        cases.append(f"WHEN ratio >= {level!r}::DOUBLE THEN {i}")
        level, i = level - 0.01, i + 1
    return "CASE " + " ".join(cases) + " END"


_COUNTS = """cnt AS (SELECT s.doc_id, s.i, c.d, c.pos, c.pref, len(s.line) - len(replace(s.line, c.d, '')) AS n FROM sample s, cand c),
tot AS (SELECT doc_id, count(*) AS total FROM sample GROUP BY doc_id)"""

_FREQUENCY = f"""{_COUNTS},
chunks(k) AS (VALUES (1), (2), (3)),
freq AS (SELECT doc_id, k, d, pref, n AS v, count(*) AS lines, min(i) AS first, least(any_value(total), 10 * k) AS total
  FROM cnt JOIN tot USING (doc_id), chunks WHERE i <= 10 * k AND total > 10 * (k - 1) GROUP BY doc_id, k, d, pref, n),
mode AS (SELECT * FROM freq QUALIFY row_number() OVER (PARTITION BY doc_id, k, d ORDER BY lines DESC, first) = 1),
rat AS (SELECT *, (2 * lines - total) / total::DOUBLE AS ratio FROM mode),
buck AS (SELECT *, {_thresholds()} AS b FROM rat WHERE v > 0 AND ratio > 0),
fvote AS (SELECT doc_id, d AS fvote FROM buck WHERE b IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k, b, pref) = 1)"""

# Quoted neighbours; the two-sided pattern needs the same character on both
# sides, so it lists every ASCII character that is no letter, digit, _, quote or LF.
_ASCII_MARKS = [chr(c) for c in range(1, 127) if not (chr(c).isalnum() or chr(c) in "_\"'\n")]
_ANY = r"""[^\p{L}\p{N}_\n"'']"""
_BOTH = "(?s)(?:" + "|".join(rf"\x{ord(d):02x} ?{q}.*?{q}\x{ord(d):02x}" for d in _ASCII_MARKS for q in ('"', "''")) + ")"
_RIGHT = rf"""(?ms)(?:^|\n)(?:".*?"{_ANY} ?|''.*?''{_ANY} ?)"""
_LEFT = rf"""(?ms){_ANY} ?(?:".*?"(?:$|\n)|''.*?''(?:$|\n))"""

_QUOTED = f"""joined AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM sample GROUP BY doc_id),
hits AS (SELECT doc_id, regexp_extract_all(t, '{_BOTH}') AS hb, regexp_extract_all(t, '{_RIGHT}') AS hr, regexp_extract_all(t, '{_LEFT}') AS hl FROM joined),
side AS (SELECT doc_id, CASE WHEN len(hb) > 0 THEN list_transform(hb, lambda m: m[1])
  WHEN len(hr) > 0 THEN list_transform(hr, lambda m: regexp_extract(m, '({_ANY})( ?)$', 1)) ELSE list_transform(hl, lambda m: m[1]) END AS ds FROM hits),
touch AS (SELECT doc_id, unnest(ds) AS d, generate_subscripts(ds, 1) AS pos FROM side),
qvote AS (SELECT doc_id, d AS qvote FROM (SELECT doc_id, d, count(*) AS n, min(pos) AS first FROM touch WHERE d IN (SELECT d FROM cand) GROUP BY doc_id, d)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1)"""

_SCORES = """sc AS (SELECT doc_id, d, pos, avg(n) - stddev_pop(n) AS score FROM cnt GROUP BY doc_id, d, pos)"""
_DENSITY = r"""tok AS (SELECT doc_id, unnest(string_split(line, ';')) AS t FROM sample),
den AS (SELECT doc_id, avg(CASE WHEN regexp_matches(trim(trim(t, ' ' || chr(9)), '"'), '^\(?-?\d{1,3}([.\s]\d{3})*,\d+\)?$') THEN 1 ELSE 0 END) AS density FROM tok GROUP BY doc_id)"""

_CHOICE = f"""{_FREQUENCY}, {_QUOTED}, {_SCORES}, {_DENSITY},
best AS (SELECT doc_id, d AS best FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, pos) = 1),
two AS (SELECT doc_id, max(score) FILTER (d = ';') AS semis, max(score) FILTER (d = ',') AS commas FROM sc GROUP BY doc_id),
choice AS (SELECT doc_id, coalesce(qvote, fvote, CASE WHEN abs(semis - commas) <= 0.35 AND density >= 0.06 THEN ';' END, best, ',') AS d,
  CASE WHEN coalesce(qvote, fvote) IS NOT NULL THEN 'sniffer' WHEN abs(semis - commas) <= 0.35 AND density >= 0.06 THEN 'euro-aware' ELSE 'heuristic' END AS method
  FROM files LEFT JOIN qvote USING (doc_id) LEFT JOIN fvote USING (doc_id) LEFT JOIN two USING (doc_id) LEFT JOIN den USING (doc_id) LEFT JOIN best USING (doc_id))"""


def _sampled(spark, sf):
    return P.with_samples(I.file_texts(spark, sf), F.col("text"))


@query("delimiter_sample", f"""{_BASE} SELECT doc_id, i::BIGINT AS i, line FROM sample""")
def delimiter_sample(spark, sf):
    s = P.unnest(_sampled(spark, sf), F.col("sample_lines"), "line", keep=["doc_id"])
    return s.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("i"), "line")


@query("delimiter_frequency_vote", f"""{_BASE}, {_FREQUENCY}
SELECT doc_id, fvote FROM files LEFT JOIN fvote USING (doc_id)""")
def delimiter_frequency_vote(spark, sf):
    return _sampled(spark, sf).select("doc_id", D.frequency_vote(F.col("sample_lines")).alias("fvote"))


@query("delimiter_vote", f"""{_BASE}, {_FREQUENCY}, {_QUOTED}
SELECT doc_id, coalesce(qvote, fvote) AS vote FROM files LEFT JOIN qvote USING (doc_id) LEFT JOIN fvote USING (doc_id)""")
def delimiter_vote(spark, sf):
    return P.with_delimiter(_sampled(spark, sf)).select("doc_id", "vote")


@query("delimiter_scores", f"""{_BASE}, {_COUNTS}, {_SCORES} SELECT doc_id, d AS delimiter, round(score, 6) AS score FROM sc""")
def delimiter_scores(spark, sf):
    s = P.unnest(_sampled(spark, sf), D.delimiter_scores(F.col("sample_lines")), "s", keep=["doc_id"])
    return s.select("doc_id", "s.delimiter", F.round("s.score", 6).alias("score"))


@query("decimal_comma_density", f"""{_BASE}, {_DENSITY} SELECT doc_id, round(density, 9) AS density FROM den""")
def decimal_comma_density(spark, sf):
    return _sampled(spark, sf).select("doc_id", F.round(D.decimal_comma_density(F.col("sample_lines"), ";"), 9).alias("density"))


@query("delimiter_choice", f"""{_BASE}, {_CHOICE} SELECT doc_id, d AS delimiter, method FROM choice""")
def delimiter_choice(spark, sf):
    return P.with_delimiter(_sampled(spark, sf)).select("doc_id", "delimiter", F.col("choice.method").alias("method"))


@query("delimiter_choice_legacy", f"""{_LEGACY}, {_FREQUENCY}, {_QUOTED}, {_SCORES},
best AS (SELECT doc_id, d AS best FROM sc WHERE score > -1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, pos) = 1)
SELECT doc_id, coalesce(qvote, fvote, best, ',') AS delimiter FROM files LEFT JOIN qvote USING (doc_id) LEFT JOIN fvote USING (doc_id) LEFT JOIN best USING (doc_id)""")
def delimiter_choice_legacy(spark, sf):
    s = I.file_texts(spark, sf).withColumn(
        "sample_lines", D.sample_lines("text", K.LEGACY_SAMPLE_CHARS, K.LEGACY_SAMPLE_LINES))
    return P.with_delimiter(s, euro_aware=False, score_floor=True).select("doc_id", "delimiter")


# --- header ----------------------------------------------------------------------

# Header queries use the delimiter each kind of file was written with.
_KIND = "CASE doc_id % 6 WHEN 2 THEN ';' WHEN 3 THEN chr(9) WHEN 4 THEN '|' ELSE ',' END"
_WIDTHS = f"""WITH {I.FILES}, {I.LINES},
fl AS (SELECT doc_id, ln, line, {_KIND} AS d FROM lines),
scan AS (SELECT *, {I.sql_fields('line', 'd')} AS f FROM fl WHERE ln < 60 AND regexp_matches(line, '\\S')),
w AS (SELECT doc_id, ln, line, d, f, len(f) AS width FROM scan),
m1 AS (SELECT doc_id, width AS mode1 FROM (SELECT doc_id, width, count(*) AS n, min(ln) AS first FROM w GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1),
m2 AS (SELECT doc_id, width AS mode2 FROM (SELECT doc_id, width, count(*) AS n, min(ln) AS first FROM w WHERE width >= 2 GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1),
modal AS (SELECT doc_id, CASE WHEN mode1 = 1 THEN coalesce(mode2, 1) ELSE mode1 END AS modal FROM m1 LEFT JOIN m2 USING (doc_id)),
candidates AS (SELECT w.*, modal FROM w JOIN modal USING (doc_id) WHERE width = modal OR ln = (SELECT min(ln) FROM w x WHERE x.doc_id = w.doc_id))"""

_SCORED = f"""{_WIDTHS},
pt AS (SELECT doc_id, ln, line, modal, list_transform(f, lambda x: trim(x, ' ' || chr(9) || chr(10))) AS p FROM candidates),
scored AS (SELECT doc_id, ln, modal,
  (len(list_filter(p, lambda x: regexp_matches(x, '[A-Za-z]'))) / greatest(len(p), 1)) * 4.0::DOUBLE
  - (len(list_filter(p, lambda x: regexp_matches(x, '^[-+]?\\d+(\\.\\d+)?$'))) / greatest(len(p), 1)) * 5.0::DOUBLE
  - (len(list_filter(p, lambda x: regexp_matches(x, '^\\d{{4}}-\\d{{2}}-\\d{{2}}'))) / greatest(len(p), 1)) * 4.0::DOUBLE
  + len(list_distinct(p)) / greatest(len(p), 1) * 2.0::DOUBLE
  - coalesce(list_sum(list_transform(p, lambda x: len(x))), 0) / greatest(len(p), 1) * 0.05::DOUBLE
  - CASE WHEN contains(line, ':') AND len(p) <= 2 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM pt)"""

_HEADER = f"""{_SCORED},
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ln) AS r FROM scored),
top AS (SELECT doc_id, any_value(modal) AS modal, max(score) FILTER (r = 1) AS s1, max(ln) FILTER (r = 1) AS ln1,
  coalesce(max(score) FILTER (r = 1) - max(score) FILTER (r = 2), 'inf'::DOUBLE) AS gap FROM ranked GROUP BY doc_id),
grp AS (SELECT doc_id, any_value(t.modal) AS modal, any_value(s1) AS s1, any_value(ln1) AS ln1, any_value(gap) AS gap,
  min(r.ln) FILTER (r.score >= s1 - 0.1::DOUBLE AND r.ln < 10) AS early, arg_min(r.score, r.ln) FILTER (r.score >= s1 - 0.1::DOUBLE AND r.ln < 10) AS early_score,
  max(r.score) FILTER (r.score < s1 - 0.1::DOUBLE) AS outside FROM ranked r JOIN top t USING (doc_id) GROUP BY doc_id),
pick AS (SELECT doc_id, modal, gap <= 0.1::DOUBLE AS tie, CASE WHEN gap <= 0.1::DOUBLE THEN coalesce(early, ln1) ELSE ln1 END AS ln,
  CASE WHEN gap <= 0.1::DOUBLE THEN coalesce(early_score, s1) ELSE s1 END AS score,
  CASE WHEN gap <= 0.1::DOUBLE THEN coalesce(s1 - outside, s1) ELSE gap END AS fgap FROM grp),
header AS (SELECT *, CASE WHEN ln > 15 THEN 'too_deep' WHEN ln > 0 AND fgap < 0.75 THEN 'unsure' WHEN ln > 0 THEN 'stripped' ELSE 'first_line' END AS status FROM pick)"""


def _kinded(spark, sf):
    k = F.col("doc_id") % 6
    d = F.when(k == 2, F.lit(";")).when(k == 3, F.lit("\t")).when(k == 4, F.lit("|")).otherwise(F.lit(","))
    return _sampled(spark, sf).withColumn("delimiter", d)


def _micro(c):
    """Six decimals by the same double arithmetic as the SQL twin."""
    x = F.col(c)
    return F.when(x == float("inf"), x).otherwise(F.floor(x * 1000000 + 0.5) / F.lit(1000000.0))


def _headed(spark, sf):
    return P.with_header(_kinded(spark, sf))


@query("field_count_profile", f"""{_WIDTHS} SELECT doc_id, ln::BIGINT AS ln, width FROM w""")
def field_count_profile(spark, sf):
    c = P.unnest(_kinded(spark, sf), D.field_counts(F.col("head_lines"), F.col("delimiter")), "c", keep=["doc_id"])
    return c.select("doc_id", F.col("c.ln").cast("bigint").alias("ln"), F.col("c.width").cast("bigint").alias("width"))


@query("modal_width", f"""{_WIDTHS} SELECT doc_id, modal FROM modal""")
def modal_width(spark, sf):
    return _headed(spark, sf).select("doc_id", F.col("modal").cast("bigint").alias("modal"))


@query("header_candidates", f"""{_WIDTHS} SELECT doc_id, ln::BIGINT AS ln FROM candidates""")
def header_candidates(spark, sf):
    c = P.unnest(_headed(spark, sf), F.col("candidates"), "ln", keep=["doc_id"])
    return c.select("doc_id", F.col("ln").cast("bigint").alias("ln"))


@query("header_scores", f"""{_SCORED} SELECT doc_id, ln::BIGINT AS ln, floor(score * 1000000 + 0.5::DOUBLE) / 1000000 AS score FROM scored""")
def header_scores(spark, sf):
    s = P.unnest(_headed(spark, sf), F.col("scored"), "s", keep=["doc_id"])
    return s.select("doc_id", F.col("s.ln").cast("bigint").alias("ln"), _micro("s.score").alias("score"))


@query("top_header_candidates", f"""{_HEADER} SELECT doc_id, r, ln::BIGINT AS ln FROM ranked WHERE r <= 3""")
def top_header_candidates(spark, sf):
    s = P.unnest(_headed(spark, sf), F.slice("scored", 1, 3), "s", keep=["doc_id"])
    return s.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("r"), F.col("s.ln").cast("bigint").alias("ln"))


@query("header_choice", f"""{_HEADER} SELECT doc_id, ln::BIGINT AS ln, tie, status, floor(score * 1000000 + 0.5::DOUBLE) / 1000000 AS score, floor(fgap * 1000000 + 0.5::DOUBLE) / 1000000 AS gap FROM header""")
def header_choice(spark, sf):
    h = _headed(spark, sf).select("doc_id", "header.*")
    return h.select("doc_id", F.col("ln").cast("bigint").alias("ln"), F.col("tie_break").alias("tie"), "status",
                    _micro("score").alias("score"), _micro("gap").alias("gap"))


@query("strip_preamble", f"""{_HEADER} SELECT doc_id, lines.ln::BIGINT AS ln, line FROM lines LEFT JOIN header USING (doc_id)
WHERE lines.ln >= CASE WHEN status = 'stripped' THEN header.ln ELSE 0 END""")
def strip_preamble(spark, sf):
    return P.strip_preamble(_headed(spark, sf), keep=["doc_id"])


@query("header_info", f"""{_HEADER} SELECT doc_id, CASE WHEN status IN ('stripped', 'too_deep') THEN 0 ELSE ln END::BIGINT AS header_line_index,
  {_KIND} AS delimiter, modal AS column_count, printf('%.2f', score)::DOUBLE AS confidence_score, printf('%.2f', fgap)::DOUBLE AS score_gap FROM header""")
def header_info(spark, sf):
    return _headed(spark, sf).select("doc_id", *P.header_info())


@query("header_messages", f"""{_HEADER},
t3 AS (SELECT doc_id, string_agg('line ' || (ln + 1) || ' score=' || printf('%.2f', score), ', ' ORDER BY r) AS t FROM ranked WHERE r <= 3 GROUP BY doc_id),
heavy AS (SELECT doc_id, mode1 = 1 AND mode2 IS NOT NULL AS heavy FROM m1 LEFT JOIN m2 USING (doc_id)),
log AS (SELECT doc_id, list_filter([
  CASE WHEN heavy THEN 'Header detection: preamble-heavy file; using modal field count ' || modal || ' from multi-field lines.' END,
  'Header candidates (top 3): ' || t, CASE WHEN tie THEN 'Header chosen after tie-break: line ' || (ln + 1) END,
  'Header selected: line ' || (ln + 1) || ' (score=' || printf('%.2f', score) || ')',
  'Header score gap: ' || CASE WHEN isinf(fgap) THEN 'inf' ELSE printf('%.2f', fgap) END, 'Header modal field count: ' || modal,
  CASE status WHEN 'too_deep' THEN 'Header detection: candidate too deep (>15); leaving file unchanged.' WHEN 'unsure' THEN 'Header check: no preamble removed.'
    WHEN 'stripped' THEN 'Header detected on line ' || (ln + 1) || '; removed ' || ln || ' preamble line(s).'
    ELSE 'Header appears to be on the first line (no preamble removed).' END], lambda x: x IS NOT NULL) AS log
  FROM header JOIN t3 USING (doc_id) JOIN heavy USING (doc_id))
SELECT doc_id, array_to_string(coalesce(log, ['Header detection: no parseable non-empty lines found.']), ' / ') AS messages FROM documents LEFT JOIN log USING (doc_id)""")
def header_messages(spark, sf):
    """All messages of every file in their order."""
    return _headed(spark, sf).select("doc_id", F.array_join("header_log", " / ").alias("messages"))


def _sql_header_like(f: str) -> str:
    """SQL verdict over a list of fields; null list means no line."""
    p = (f"list_filter(list_transform({f}, lambda x: trim(trim(trim(x, ' ' || chr(9) || chr(10)), '\"'), ' ' || chr(9) || chr(10))), lambda x: x <> '')")
    number = "regexp_matches(x, '^[-+]?\\d+(\\.\\d+)?$')"
    date = "(regexp_matches(x, '^\\d{1,2}/\\d{1,2}/\\d{2,4}') OR regexp_matches(x, '^\\d{8}(_\\d{6})?$'))"
    code = "regexp_matches(x, '^[A-Za-z]\\d{1,3}$')"
    label = "(regexp_matches(x, '^[A-Za-z_][A-Za-z0-9_]*$') AND (contains(x, '_') OR x = lower(x)) AND len(x) <= 24)"
    return (f"(CASE WHEN len({p}) = 0 THEN false WHEN regexp_matches({p}[1], '^\\d{{6,}}$') THEN false "
            f"WHEN len(list_filter({p}, lambda x: contains(x, '@'))) > 0 THEN false "
            f"WHEN list_sum(list_transform({p}, lambda x: len(x))) / len({p}) > 24 THEN false "
            f"ELSE len(list_filter({p}, lambda x: NOT ({number} OR {date} OR {code}) AND {label})) / len({p}) >= 0.6::DOUBLE "
            f"AND len(list_filter({p}, lambda x: {number} OR {date} OR {code})) / len({p}) <= 0.3::DOUBLE END)")


@query("header_likeness", f"""WITH {I.FILES}, {I.LINES}, fl AS (SELECT doc_id, ln, line, {_KIND} AS d FROM lines),
f AS (SELECT doc_id, ln, {I.sql_fields('line', 'd')} AS f FROM fl)
SELECT doc_id, ln::BIGINT AS ln, {_sql_header_like('f')} AS is_header FROM f""")
def header_likeness(spark, sf):
    from ..functions.text import lines

    l = _kinded(spark, sf).select("doc_id", "delimiter", F.posexplode(lines("text")).alias("ln", "line"))
    f = l.withColumn("f", fields("line", F.col("delimiter")))
    return f.select("doc_id", F.col("ln").cast("bigint").alias("ln"), D.looks_like_header(F.col("f")).alias("is_header"))


@query("synthetic_header", f"""{_HEADER},
f12 AS (SELECT doc_id, ln, {I.sql_fields('line', 'd')} AS f FROM fl WHERE ln < 2),
v AS (SELECT doc_id, any_value(f) FILTER (ln = 0) AS f1, bool_or({_sql_header_like('f')}) AS any_header FROM f12 GROUP BY doc_id)
SELECT doc_id, NOT any_header AND coalesce(status, '') <> 'stripped' AS synthesized,
  CASE WHEN NOT any_header AND coalesce(status, '') <> 'stripped' THEN array_to_string(list_transform(range(1, len(f1) + 1), lambda i: 'col_' || i), ',') END AS names
FROM v LEFT JOIN header USING (doc_id)""")
def synthetic_header(spark, sf):
    s = P.with_synthetic_header(_headed(spark, sf))
    return s.select("doc_id", F.col("synthetic").isNotNull().alias("synthesized"), F.array_join("synthetic", ",").alias("names"))


