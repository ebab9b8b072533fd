"""Report messages as templates filled by ``format_string``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

# --- fixed values: message texts, in the order of a run ------------------------
TEXT = {
    # structure
    "newlines": "Normalized line endings (fixed Windows/Mac-style newlines).",
    "encoding_utf8": "Detected encoding: utf-8.",
    "encoding_other": "Detected encoding: %s. Converted to UTF-8 for output compatibility.",
    "stitch_merged": "Quote stitching: merged %s physical lines into %s logical rows (records stitched: %s, max lines/record: %s).",
    "stitch_none": "Quote stitching: no multi-line quoted records detected.",
    "stitch_fixed": "Fixed %s multiline quoted record(s).",
    "stitch_check": "Quote stitching check: no multiline quoted records found.",
    "synthetic": "Header missing: generated a synthetic header row (col_1, col_2, …).",
    # delimiter
    "delimiter_sniffer": "Detected delimiter: '%s' (sniffer).",
    "delimiter_euro": "Detected delimiter: ';' (euro-aware: decimal comma density %s%%).",
    "delimiter_heuristic": "Detected delimiter: '%s' (heuristic).",
    # header
    "header_unparseable": "Header detection: no parseable non-empty lines found.",
    "header_preamble_heavy": "Header detection: preamble-heavy file; using modal field count %s from multi-field lines.",
    "header_candidates": "Header candidates (top 3): %s",
    "header_candidate": "line %s score=%s",
    "header_tie_break": "Header chosen after tie-break: line %s",
    "header_selected": "Header selected: line %s (score=%s)",
    "header_gap": "Header score gap: %s",
    "header_modal": "Header modal field count: %s",
    "header_too_deep": "Header detection: candidate too deep (>%s); leaving file unchanged.",
    "header_unsure": "Header check: no preamble removed.",
    "header_stripped": "Header detected on line %s; removed %s preamble line(s).",
    "header_first_line": "Header appears to be on the first line (no preamble removed).",
    # import
    "import_too_long": "Fixed %s rows with extra columns (import repair).",
    "import_too_short": "Fixed %s rows with missing columns (import repair).",
    "import_consistent": "Row structure was consistent (no import repairs needed).",
    # cleaning
    "names": "Normalized column names (consistent and import-friendly).",
    "trim_no_columns": "No text columns found for whitespace cleanup.",
    "trim_none": "No whitespace issues found in text cells.",
    "trim_changed": "Trimmed whitespace in %s text cells (prevents grouping/matching issues).",
    "empty_removed": "Removed %s fully empty rows.",
    "empty_none": "No fully empty rows found.",
    "duplicates_removed": "Removed %s duplicate rows (exact matches).",
    "duplicates_none": "No exact duplicate rows found.",
    "numbers_converted": "Normalized numeric formats in %s column(s) (EU/US separators, parentheses negatives).",
    "numbers_none": "Numeric normalization: no eligible numeric columns detected.",
    # near-duplicates
    "near_none": "No near-duplicate rows found (using the near-duplicate rules).",
    "near_removed": "Removed %s near-duplicate rows.",
    "near_preview": "Dry run: %s near-duplicate rows would be removed.",
    "near_rule": "Near-duplicate rule: compare all columns except %s.",
    # output
    "output": "Wrote output as UTF-8 with standard newlines using delimiter '%s'.",
}


def message(name: str, *values) -> Column:
    """The text of a message with its placeholders filled from columns."""
    if not values:
        return F.lit(TEXT[name].replace("%%", "%"))
    return F.format_string(TEXT[name], *[_col(v).cast("string") for v in values])


def grouped(c) -> Column:
    """A count with thousands separators."""
    return F.format_number(_col(c), 0)


def shown_delimiter(d) -> Column:
    return F.replace(_col(d), F.lit("\t"), F.lit("\\t"))


def counted(count: str, some: str, none: str) -> Column:
    """``some`` with the count when there is any, else ``none``."""
    return F.when(F.col(count) > 0, message(some, grouped(count))).otherwise(message(none))
