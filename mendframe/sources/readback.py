"""Delimited output read back in parallel.

Spark's CSV reader takes a part whose cells hold line breaks as one task
(``multiLine``).  Here the parts are scanned as LF segments in their input
splits, and records are cut by the quote state of their lines, as for
repaired files: each block's effect is composed, the blocks' effects are
combined in file order, and only lines of multi-line records move.  A 1 GB
part is many tasks.

Semantics follow the writer of ``sinks.write_delimited``: each part opens
with the header line; an empty cell (written for null and for the empty
string alike) is null; an empty line is no row.  With ``schema`` (such as a
manifest's) the cells are cast by position; without, each column takes the
first of int, bigint, double, boolean that all its cells fit, else string,
by one aggregate.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import records as R
from . import files as S
from .workspace import Workspace

INFERRED = ("int", "bigint", "double", "boolean")


def read_records_of(spark: SparkSession, path: str, delimiter: str, ws: Workspace) -> DataFrame:
    """(file, ln, fields) of every record of the parts below ``path``, the header lines (ln 0) included."""
    segments = ws.save(S.read_segments(spark, [path]), "readback_segments")
    blocks = ws.save(S.number_blocks(S.block_facts(segments)), "readback_blocks")
    facts = blocks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or("inner_cr"), F.lit(False)).alias("cr"),
                       F.coalesce(F.bool_or("has_quote"), F.lit(False)).alias("quote")).first()
    n_blocks = facts["n"]
    planned = ws.save(blocks.join(S.file_facts(blocks).select("file", "encoding", "bom"), "file").select(
        "file", "blk", "mid0", "ln_before", "inner_cr", "encoding", "bom", F.lit(delimiter).alias("delimiter"),
        F.lit(0).cast("bigint").alias("header_ln"), F.lit(False).alias("open_tail_nl")), "readback_plan")
    keep = ["delimiter", "header_ln"]
    effects = None
    if facts["quote"]:
        quoted = S.lines(segments, planned, n_blocks, facts["cr"], keep, quoted_only=True)
        effects = ws.save(R.quote_effects(quoted), "readback_effects")
    body = S.lines(segments, planned, n_blocks, facts["cr"], keep).drop("header_ln")
    records, _ = R.read_records(body, effects, planned, n_blocks, ws)
    return records.filter(F.col("text") != "").select("file", "ln", X.fields("text", F.col("delimiter")).alias("fields"))


def read_split(spark: SparkSession, path: str, delimiter: str = ",", schema: str | None = None, infer: bool = True,
               work: Workspace | None = None) -> DataFrame:
    """The table written below ``path``; a missing folder or one without parts is a table without columns and rows."""
    ws = work or Workspace(spark)
    try:
        recs = ws.save(read_records_of(spark, path, delimiter, ws), "readback_records")
    except AnalysisException:
        return spark.range(0).select()
    header = recs.filter(F.col("ln") == 0).select("fields").first()
    if header is None:
        return spark.range(0).select()
    rows = recs.filter(F.col("ln") > 0)
    cell = lambda i: F.nullif(F.get("fields", F.lit(i)), F.lit(""))
    if schema is not None:
        fields = T._parse_datatype_string(schema).fields
        return rows.select([cell(i).cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])
    names = list(header["fields"])
    fits = [F.bool_and(F.col(f"_c{i}").isNull() | F.expr(f"try_cast(`_c{i}` AS {t})").isNotNull()).alias(f"{i}:{t}")
            for i in range(len(names)) for t in INFERRED] if infer else []
    shaped = rows.select([cell(i).alias(f"_c{i}") for i in range(len(names))])
    got = shaped.agg(*fits).first() if fits else None
    kinds = [next((t for t in INFERRED if got[f"{i}:{t}"] is not False), "string") if got else "string" for i in range(len(names))]
    return shaped.select([F.col(f"_c{i}").cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))])
