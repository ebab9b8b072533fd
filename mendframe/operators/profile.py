"""Structure profile of files: delimiter, header, preamble.

Input is one row per file with a text column (or ready head and sample
arrays); output is the same rows with profile columns.  Each step is its own
projection, so shared intermediate results are computed once, and the whole
profile is a narrow job: no shuffle, one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import detect as D
from ..functions.rounding import round2
from ..functions.text import _col, lines


def with_samples(df: DataFrame, text) -> DataFrame:
    """Add ``sample_lines`` and ``head_lines`` of a text column."""
    return df.withColumns({"sample_lines": D.sample_lines(text), "head_lines": D.head_lines(text)})


def with_delimiter(df: DataFrame, euro_aware: bool = True, score_floor: bool = False) -> DataFrame:
    """Add vote, scores, density and ``choice`` struct from ``sample_lines``."""
    sample = F.col("sample_lines")
    scored = df.withColumns({
        "vote": D.delimiter_vote(sample),
        "scores": D.delimiter_scores(sample),
        "density": D.decimal_comma_density(sample, ";"),
    })
    chosen = scored.withColumn(
        "choice", D.choose_delimiter(F.col("vote"), F.col("scores"), F.col("density"), euro_aware, score_floor)
    )
    return chosen.withColumn("delimiter", F.col("choice.delimiter"))


def with_header(df: DataFrame) -> DataFrame:
    """Add field counts, modal width, ranked candidates and the ``header`` struct."""
    head, d = F.col("head_lines"), F.col("delimiter")
    return (
        df.withColumn("counts", D.field_counts(head, d))
        .withColumn("modal", D.modal_width(F.col("counts")))
        .withColumn("candidates", D.header_candidates(F.col("counts"), F.col("modal")))
        .withColumn("scored", D.score_candidates(head, F.col("candidates"), d))
        .withColumn("header", D.choose_header(F.col("scored")))
        .withColumns({
            "stripped": F.coalesce(F.col("header.status") == "stripped", F.lit(False)),
            "header_log": D.header_messages(F.col("scored"), F.col("header"), F.col("counts"), F.col("modal")),
        })
        .withColumn("header_ln", F.when(F.col("stripped"), F.col("header.ln")).otherwise(F.lit(0)))
    )


def with_synthetic_header(df: DataFrame, respect_selected_header: bool = False) -> DataFrame:
    """Add ``synthetic``: generated names for a headerless file, else null.

    ``respect_selected_header`` keeps the first line as header when header
    detection picked it with a clear gap.
    """
    names = D.synthetic_header(F.col("head_lines"), F.col("delimiter"), F.col("stripped"))
    if respect_selected_header:
        h = F.col("header")
        clear = (h.getField("status") == "first_line") & ~h.getField("tie_break") & (h.getField("gap") >= K.HEADER_MIN_GAP)
        names = F.when(~F.coalesce(clear, F.lit(False)), names)
    return df.withColumn("synthetic", names)


def header_info() -> list[Column]:
    """Header facts as reported for a run (the index is 0 after a strip)."""
    h = F.col("header")
    kept = h.getField("status").isin("stripped", "too_deep")
    return [
        F.when(kept, F.lit(0)).otherwise(h.getField("ln")).cast("bigint").alias("header_line_index"),
        F.col("delimiter"),
        F.col("modal").cast("bigint").alias("column_count"),
        round2(h.getField("score")).alias("confidence_score"),
        round2(h.getField("gap")).alias("score_gap"),
    ]


def profile(df: DataFrame, text="text", respect_selected_header: bool = False) -> DataFrame:
    """Complete profile of one-row-per-file texts."""
    staged = with_header(with_delimiter(with_samples(df, _col(text))))
    return with_synthetic_header(staged, respect_selected_header)


def unnest(df: DataFrame, array: Column, value: str, pos: str = "pos", keep: Sequence[str] = ()) -> DataFrame:
    """One row per array element, numbered from 0.

    ``posexplode`` makes Spark infer a filter on the array's size, which is
    pushed below the profile's projections and computes the whole profile a
    second time; the outer form with a later null filter does not.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, value)).filter(F.col(pos).isNotNull())


def strip_preamble(df: DataFrame, text="text", keep: Sequence[str] = ()) -> DataFrame:
    """(ln, line) of the lines from the header on, ln counted in the whole file."""
    body = F.transform(
        F.slice(lines(text), F.col("header_ln") + 1, F.length(_col(text)) + 1),
        lambda line, i: F.struct((i + F.col("header_ln")).cast("bigint").alias("ln"), line.alias("line")),
    )
    return unnest(df, body, "_row", keep=keep).select(*keep, "_row.*")
