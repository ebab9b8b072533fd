"""Structure detection over the first lines of a file.

Every function is a column expression over an array of lines, so a file's
profile is computed in its own row: no line is exploded and nothing is
shuffled.  The arrays are short by definition (30 sample lines, 60 header
lines), whatever the size of the file.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .messages import message, shown_delimiter
from .rounding import fixed2
from .text import _col, count_char, fields, is_blank, let, lines as text_lines, strip


def _nonblank(arr: Column) -> Column:
    return F.filter(arr, lambda l: ~is_blank(l))


def _share(arr: Column, cond, size: Column | None = None) -> Column:
    return F.size(F.filter(arr, cond)) / (F.size(arr) if size is None else size)


def _mean(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / F.size(arr)


def most_common(arr: Column) -> Column:
    """struct(n, rank, v) of the most frequent element; the first seen wins a tie."""
    def vote(xs):
        return F.array_max(F.transform(
            F.array_distinct(xs),
            lambda v, i: F.struct(F.size(F.filter(xs, lambda x: x == v)).alias("n"), (-i).alias("rank"), v.alias("v")),
        ))

    return let(arr, vote)


# --------------------------------------------------------------------------
# Delimiter
# --------------------------------------------------------------------------

def sample_lines(text, chars: int = K.SAMPLE_CHARS, max_lines: int = K.SAMPLE_LINES) -> Column:
    """The detection sample: non-blank lines of the first characters."""
    return F.slice(_nonblank(F.split(F.substring(_col(text), 1, chars), "\n")), 1, max_lines)


def head_lines(text, max_lines: int = K.HEADER_SCAN_LINES) -> Column:
    """The first lines of a text; a final newline opens no further line."""
    return text_lines(F.substring_index(_col(text), "\n", max_lines))


# Neighbourhoods of a quoted run: both sides, right side, left side, none.
_NOT_WORD = r"""[^\p{L}\p{N}_\n"']"""
_QUOTED_BOTH = rf"""(?msd)({_NOT_WORD})( ?)(["']).*?\3\1"""
_QUOTED_RIGHT = rf"""(?msd)(?:^|\n)(["']).*?\1({_NOT_WORD})( ?)"""
_QUOTED_LEFT = rf"""(?msd)({_NOT_WORD})( ?)(["']).*?\3(?:$|\n)"""


def quoted_neighbour_vote(lines: Column) -> Column:
    """Delimiter that most often touches a quoted run, null when none does."""
    sample = F.array_join(lines, "\n")

    def vote(found):
        known = F.filter(found, lambda d: d.isin(*K.CANDIDATE_DELIMITERS))
        return most_common(known).getField("v")

    both = F.regexp_extract_all(sample, F.lit(_QUOTED_BOTH), F.lit(1))
    right = F.regexp_extract_all(sample, F.lit(_QUOTED_RIGHT), F.lit(2))
    left = F.regexp_extract_all(sample, F.lit(_QUOTED_LEFT), F.lit(1))
    return F.when(
        sample.rlike("""["']"""),
        F.when(F.size(both) > 0, vote(both)).when(F.size(right) > 0, vote(right)).when(F.size(left) > 0, vote(left)),
    )


def _thresholds() -> list[float]:
    """1.0, 0.99, ... down to 0.90, as doubles reached by repeated subtraction."""
    levels, level = [], 1.0
    while level >= 0.9:
        levels.append(level)
        level -= 0.01
    return levels


def frequency_vote(lines: Column) -> Column:
    """Delimiter with the steadiest count per line, null when none is steady.

    Looks at 10, then 20, then 30 lines and stops at the first size at which
    some delimiter is steady enough; the highest consistency level decides,
    then the preference order.
    """
    n = F.size(lines)
    levels = F.array(*[F.lit(t) for t in _thresholds()])
    candidates = F.array(*[
        F.struct(F.lit(d).alias("d"), F.lit(i).alias("preference")) for i, d in enumerate(K.SNIFFER_PREFERENCE)
    ])

    def judge(chunks, candidate):
        counts = F.transform(F.slice(lines, F.lit(1), 10 * chunks), lambda l: count_char(l, candidate.getField("d")))

        def verdict(mode):
            total = F.least(n, 10 * chunks)
            ratio = (2 * mode.getField("n") - total) / total.cast("double")
            # Levels above the ratio are missed; null when the lowest one is.
            missed = let(ratio, lambda r: F.size(F.filter(levels, lambda t: t > r)))
            fit = (mode.getField("v") > 0) & (ratio > 0) & (missed < F.size(levels))
            return F.when(fit, F.struct(
                chunks.alias("chunks"), missed.alias("level"), candidate.getField("preference").alias("preference"),
                candidate.getField("d").alias("delimiter"),
            ))

        return let(most_common(counts), verdict)

    sizes = F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: n > 10 * (k - 1))
    verdicts = F.flatten(F.transform(sizes, lambda k: F.transform(candidates, lambda c: judge(k, c))))
    return F.array_min(F.filter(verdicts, lambda v: v.isNotNull())).getField("delimiter")


def delimiter_vote(lines: Column) -> Column:
    return F.coalesce(quoted_neighbour_vote(lines), frequency_vote(lines))


def consistency_score(lines: Column, delimiter: str) -> Column:
    """Mean minus population deviation of the delimiter's count per line."""
    counts = F.transform(lines, lambda l: count_char(l, delimiter).cast("double"))

    def score(cs):
        return let(_mean(cs), lambda mean: mean - F.sqrt(
            F.aggregate(cs, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(cs)
        ))

    return F.when(F.size(lines) == 0, F.lit(-1.0)).otherwise(let(counts, score))


def decimal_comma_density(lines: Column, delimiter: str) -> Column:
    """Share of tokens that look like a decimal-comma number."""
    tokens = F.flatten(F.transform(lines, lambda l: F.split(l, "\\" + delimiter)))

    def density(ts):
        hits = F.filter(ts, lambda t: F.btrim(strip(t), F.lit('"')).rlike(K.EURO_NUMBER))
        return F.when(F.size(ts) > 0, F.size(hits) / F.size(ts)).otherwise(F.lit(0.0))

    return let(tokens, density)


def delimiter_scores(lines: Column) -> Column:
    """array<struct<score, rank, delimiter>>, one entry per candidate in order."""
    return F.array(*[
        F.struct(consistency_score(lines, d).alias("score"), F.lit(-i).alias("rank"), F.lit(d).alias("delimiter"))
        for i, d in enumerate(K.CANDIDATE_DELIMITERS)
    ])


def choose_delimiter(vote: Column, scores: Column, density: Column,
                     euro_aware: bool = True, score_floor: bool = False) -> Column:
    """struct(delimiter, method, euro_density) from vote, scores and density of ``;``.

    ``score_floor`` keeps the first candidate unless a score exceeds -1.
    """
    def score(delimiter):
        return F.get(scores, F.lit(K.CANDIDATE_DELIMITERS.index(delimiter))).getField("score")

    best = F.array_max(scores)
    heuristic = best.getField("delimiter")
    if score_floor:
        heuristic = F.when(best.getField("score") > -1.0, heuristic).otherwise(F.lit(K.CANDIDATE_DELIMITERS[0]))
    close = F.abs(score(";") - score(",")) <= K.EURO_SCORE_DISTANCE
    euro = close & (density >= K.EURO_MIN_DENSITY) if euro_aware else F.lit(False)
    return F.struct(
        F.when(vote.isNotNull(), vote).when(euro, F.lit(";")).otherwise(heuristic).alias("delimiter"),
        F.when(vote.isNotNull(), F.lit("sniffer")).when(euro, F.lit("euro-aware")).otherwise(F.lit("heuristic")).alias("method"),
        density.alias("euro_density"),
    )


def delimiter_message(choice: Column) -> Column:
    shown, method = shown_delimiter(choice.getField("delimiter")), choice.getField("method")
    share = F.format_number(choice.getField("euro_density") * 100, 1)
    return (
        F.when(method == "euro-aware", message("delimiter_euro", share))
        .when(method == "sniffer", message("delimiter_sniffer", shown))
        .otherwise(message("delimiter_heuristic", shown))
    )


# --------------------------------------------------------------------------
# Header
# --------------------------------------------------------------------------

def field_counts(lines: Column, delimiter) -> Column:
    """array<struct<ln, width>> of the non-blank lines, ln counted from 0."""
    rows = F.transform(
        lines,
        lambda l, i: F.struct(i.alias("ln"), F.when(~is_blank(l), F.size(fields(l, delimiter))).alias("width")),
    )
    return F.filter(rows, lambda r: r.getField("width").isNotNull())


def modal_width(counts: Column) -> Column:
    """Most common width; if that is 1 and wider lines exist, the mode of those."""
    widths = F.transform(counts, lambda r: r.getField("width"))
    wide = F.filter(widths, lambda w: w >= 2)
    mode = most_common(widths).getField("v")
    return F.when((mode == 1) & (F.size(wide) > 0), most_common(wide).getField("v")).otherwise(mode)


def preamble_heavy(counts: Column) -> Column:
    widths = F.transform(counts, lambda r: r.getField("width"))
    return (most_common(widths).getField("v") == 1) & (F.size(F.filter(widths, lambda w: w >= 2)) > 0)


def header_candidates(counts: Column, modal: Column) -> Column:
    """Line numbers as wide as the mode, and the first non-blank line."""
    first = F.element_at(counts, 1).getField("ln")
    kept = F.filter(counts, lambda r: (r.getField("width") == modal) | (r.getField("ln") == first))
    return F.transform(kept, lambda r: r.getField("ln"))


def header_score(line: Column, delimiter) -> Column:
    """How much a line looks like a header (letters, distinct, short cells)."""
    def score(parts):
        n = F.greatest(F.size(parts), F.lit(1))
        length = F.aggregate(parts, F.lit(0), lambda a, x: a + F.length(x)) / n
        base = (
            _share(parts, lambda p: p.rlike("[A-Za-z]"), n) * K.SCORE_LETTERS
            + _share(parts, lambda p: p.rlike(K.PLAIN_NUMBER), n) * K.SCORE_NUMBERS
            + _share(parts, lambda p: p.rlike(K.ISO_DATE), n) * K.SCORE_DATES
            + F.size(F.array_distinct(parts)) / n * K.SCORE_DISTINCT
            + length * K.SCORE_MEAN_LENGTH
        )
        title = F.contains(line, F.lit(":")) & (n <= 2)
        return base + F.when(title, F.lit(K.SCORE_TITLE)).otherwise(F.lit(0.0))

    return let(F.transform(fields(line, delimiter), strip), score)


def score_candidates(lines: Column, candidates: Column, delimiter) -> Column:
    """array<struct<score, ln>>, best first, earlier line first on equal scores."""
    scored = F.transform(
        candidates,
        lambda i: F.struct(header_score(F.get(lines, i), delimiter).alias("score"), (-i).alias("neg_ln")),
    )
    return F.transform(
        F.sort_array(scored, asc=False),
        lambda s: F.struct(s.getField("score").alias("score"), (-s.getField("neg_ln")).alias("ln")),
    )


def choose_header(scored: Column) -> Column:
    """struct(ln, score, gap, tie_break, status) from ranked candidates.

    status: ``first_line``, ``stripped``, ``unsure`` or ``too_deep``; only
    ``stripped`` removes the lines above the header.
    """
    top, second = F.element_at(scored, 1), F.try_element_at(scored, F.lit(2))
    top_score = top.getField("score")
    floor = top_score - K.HEADER_TIE
    gap = F.coalesce(top_score - second.getField("score"), F.lit(float("inf")))
    tie = gap <= K.HEADER_TIE
    early = F.array_min(F.transform(
        F.filter(scored, lambda s: (s.getField("score") >= floor) & (s.getField("ln") < K.HEADER_PREFER_WITHIN)),
        lambda s: F.struct(s.getField("ln").alias("ln"), s.getField("score").alias("score")),
    ))
    outside = F.array_max(F.transform(
        F.filter(scored, lambda s: s.getField("score") < floor), lambda s: s.getField("score")
    ))
    ln = F.when(tie & early.isNotNull(), early.getField("ln")).otherwise(top.getField("ln"))
    score = F.when(tie & early.isNotNull(), early.getField("score")).otherwise(top_score)
    final_gap = F.when(tie, F.coalesce(top_score - outside, top_score)).otherwise(gap)
    status = (
        F.when(ln > K.HEADER_MAX_PREAMBLE, F.lit("too_deep"))
        .when((ln > 0) & (final_gap < K.HEADER_MIN_GAP), F.lit("unsure"))
        .when(ln > 0, F.lit("stripped"))
        .otherwise(F.lit("first_line"))
    )
    return F.struct(
        ln.alias("ln"), score.alias("score"), final_gap.alias("gap"), tie.alias("tie_break"), status.alias("status")
    )


def looks_like_header(cells: Column) -> Column:
    """True for a row of labels, False for a row of data."""
    def kind(t):
        number = t.rlike(K.PLAIN_NUMBER)
        date = t.rlike(K.SLASH_DATE) | t.rlike(K.COMPACT_DATE)
        code = t.rlike(K.SHORT_CODE)
        label = (
            t.rlike(K.PLAIN_LABEL)
            & (F.contains(t, F.lit("_")) | (t == F.lower(t)))
            & (F.length(t) <= K.LABEL_MAX_LENGTH)
        )
        return F.when(number | date | code, F.lit("data")).when(label, F.lit("label")).otherwise(F.lit("other"))

    def verdict(parts):
        n = F.size(parts)
        mean_len = F.aggregate(parts, F.lit(0), lambda a, x: a + F.length(x)) / n
        kinds = F.transform(parts, kind)
        labels = F.size(F.filter(kinds, lambda k: k == "label"))
        data = F.size(F.filter(kinds, lambda k: k == "data"))
        is_data = (
            F.element_at(parts, 1).rlike(K.LONG_NUMBER)
            | F.exists(parts, lambda p: F.contains(p, F.lit("@")))
            | (mean_len > K.LABEL_MAX_LENGTH)
        )
        mostly_labels = (labels / n >= K.LABEL_MIN_SHARE) & (data / n <= K.DATA_MAX_SHARE)
        return F.when(n == 0, F.lit(False)).when(is_data, F.lit(False)).otherwise(mostly_labels)

    cleaned = F.transform(cells, lambda c: strip(F.btrim(strip(c), F.lit('"'))))
    return let(F.filter(cleaned, lambda p: p != F.lit("")), verdict)


def synthetic_header(lines: Column, delimiter, stripped: Column) -> Column:
    """``col_1..col_n`` when neither of the first two lines looks like a header.

    Null when the file has a header of its own.
    """
    first = fields(F.get(lines, F.lit(0)), delimiter)
    second = fields(F.get(lines, F.lit(1)), delimiter)
    headerless = (
        ~stripped
        & (F.size(lines) >= 1)
        & ~looks_like_header(first)
        & ((F.size(lines) < 2) | ~looks_like_header(second))
    )
    names = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(first)), lambda i: i > 0),
        lambda i: F.concat(F.lit("col_"), i.cast("string")),
    )
    return F.when(headerless, names)


# --------------------------------------------------------------------------
# Messages
# --------------------------------------------------------------------------

def header_messages(scored: Column, choice: Column, counts: Column, modal: Column) -> Column:
    """Ordered list of messages about the header decision."""
    ln, status = choice.getField("ln"), choice.getField("status")
    top = F.array_join(F.transform(
        F.slice(scored, 1, 3),
        lambda s: message("header_candidate", s.getField("ln") + 1, fixed2(s.getField("score"))),
    ), ", ")
    steps = F.array(
        F.when(preamble_heavy(counts), message("header_preamble_heavy", modal)),
        message("header_candidates", top),
        F.when(choice.getField("tie_break"), message("header_tie_break", ln + 1)),
        message("header_selected", ln + 1, fixed2(choice.getField("score"))),
        message("header_gap", fixed2(choice.getField("gap"))),
        message("header_modal", modal),
        F.when(status == "too_deep", message("header_too_deep", F.lit(K.HEADER_MAX_PREAMBLE)))
        .when(status == "unsure", message("header_unsure"))
        .when(status == "stripped", message("header_stripped", ln + 1, ln))
        .otherwise(message("header_first_line")),
    )
    return F.when(F.size(counts) == 0, F.array(message("header_unparseable"))).otherwise(
        F.filter(steps, lambda m: m.isNotNull()))
