"""Reading delimited text files of any number and size.

Files are read as LF-separated byte segments, keeping every byte: a CR stays
in its segment, and the file size tells what the text reader drops (a BOM, the
final newline).  A segment is addressed by (file, block, id); blocks are the
input splits, so one huge file is many blocks and no step puts a file on one
task.  Facts about blocks and files are small tables that are joined back by
(file, block), a key that never holds more than one split.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X
from ..functions.detect import sample_lines
from .workspace import Workspace

# Fact tables up to this many rows (some 300 bytes each, most of it the path) are broadcast as they are.
BROADCAST_ROWS = 50_000

# Up to this many (128 TB in blocks of 128 MB), facts are broadcast under a 96-bit hash of file and block instead of
# the path: at most some 100 bytes each.  Only beyond that are rows shuffled by (file, block).
NARROW_ROWS = 1_000_000

# The first scan cuts at LF and skips a segment longer than this (a file of CR line ends is one such segment); the
# bytes it skipped show in the file's facts, and the file is read again with the separator its facts call for.
MAX_SEGMENT_BYTES = 64 << 20


def list_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, n_bytes, modified, name) without reading any content.

    The scan skips files of zero bytes; they are taken from Spark's own file
    index, which holds the names of all input files.
    """
    found = spark.read.format("binaryFile").load(list(paths))
    listed = found.select(
        F.col("_metadata.file_path").alias("file"), F.col("length").alias("n_bytes"),
        F.col("modificationTime").alias("modified"),
    )
    names = found.inputFiles()
    if len(names) > listed.count():
        every = spark.createDataFrame([(n,) for n in names], "file string")
        same = F.regexp_replace("file", r"^(\w+):/+", "$1:/")  # file:/x and file:///x
        zero = every.withColumn("_p", same).join(listed.select(same.alias("_p")), "_p", "left_anti").drop("_p")
        listed = listed.unionByName(zero.withColumn("n_bytes", F.lit(0).cast("bigint")), allowMissingColumns=True)
    base = F.element_at(F.split("file", "/"), -1)
    return listed.withColumn("name", F.url_decode(F.replace(base, F.lit("+"), F.lit("%2B"))))


def read_segments(spark: SparkSession, paths: Sequence[str], sep: str = "\n", max_segment: int | None = None) -> DataFrame:
    """(file, file_bytes, blk, mid, raw, sep): the segments between separators, as bytes.

    Every byte but the separators is kept; the separator is a column, so the
    file size still tells what the reader dropped (a BOM, the final one).
    With ``max_segment`` a longer segment is skipped whole (read, not kept).
    """
    reader = spark.read.option("lineSep", sep)
    if max_segment:
        reader = reader.option("mapreduce.input.linerecordreader.line.maxlength", str(max_segment))
    text = reader.text(list(paths))
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("file_bytes"),
        F.col("_metadata.file_block_start").alias("blk"),
        F.monotonically_increasing_id().alias("mid"),
        F.col("value").cast("binary").alias("raw"),
        F.lit(sep).alias("sep"),
    )


def second_scan(listed: DataFrame, blocks: DataFrame) -> DataFrame:
    """(file, sep) of the files that the LF scan can't serve, from its block facts.

    A file is cut at CR when bare CRs outnumber its LF segments, or when the
    scan skipped its bytes and found at most one LF in it (a large file of CR
    line ends).  A file with skipped bytes and more LFs has a segment above
    ``MAX_SEGMENT_BYTES`` and is read again at LF without that bound.
    """
    per = blocks.groupBy("file").agg(F.sum("n_segs").alias("n_segs"), F.sum("bare_cr").alias("bare_cr"),
                                     F.sum("n_bytes").alias("kept"))
    sizes = listed.filter(F.col("reason").isNull()).select("file", F.col("n_bytes").alias("size"))
    j = sizes.join(per, "file", "left")
    lost = (F.col("size") - F.coalesce("kept", F.lit(0))) > 3
    cr = F.coalesce(F.col("bare_cr") > F.col("n_segs"), F.lit(False))
    few = F.coalesce(F.col("n_segs"), F.lit(0)) <= 1
    return j.filter(lost | cr).select("file", F.when(cr | few, F.lit("\r")).otherwise(F.lit("\n")).alias("sep"))


def readable(uri: str) -> str:
    """A listed file name as a path the reader takes literally: decoded, glob characters escaped."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(uri))


def original_lines(bronze: DataFrame, file: str) -> DataFrame:
    """The stored raw segments of one file, in order."""
    return bronze.filter(F.col("file") == file).orderBy("blk", "mid").select("raw")


def block_facts(segments: DataFrame) -> DataFrame:
    """One row per block, from one aggregate with map-side combine."""
    l1 = X.latin1_text("raw")
    inner_cr = X.count_char(l1, "\r") - F.endswith(l1, F.lit("\r")).cast("int")
    return segments.groupBy("file", "file_bytes", "blk").agg(
        F.min("mid").alias("mid0"),
        F.sum(F.octet_length("raw") + F.lit(1)).alias("n_bytes"),
        F.sum(F.lit(1) + inner_cr).alias("n_lines"),
        (F.sum(inner_cr) > 0).alias("inner_cr"),
        F.bool_or(F.contains(l1, F.lit("\r")) | (F.col("sep") == "\r")).alias("has_cr"),
        F.bool_or(F.contains(l1, F.lit('"'))).alias("has_quote"),
        F.bool_or(F.contains(l1, F.lit("\u0000"))).alias("has_nul"),
        F.bool_and(F.is_valid_utf8(F.col("raw").cast("string"))).alias("valid"),
        F.bool_or(X.has_cp1252_undefined("raw")).alias("undefined"),
        F.max_by(F.endswith(l1, F.lit("\r")), "mid").alias("last_cr"),
        F.count(F.lit(1)).alias("n_segs"),
        F.sum(inner_cr).alias("bare_cr"),
    )


def file_facts(blocks: DataFrame) -> DataFrame:
    """(file, encoding, bom, has_cr, ends_nl, n_lines, has_quote) from the blocks.

    Segments count their bytes plus one separator each (LF, or CR for files
    cut at CR); against the file size that leaves 0 or -1 (final line end or
    not), plus 3 for a BOM.
    """
    rest = F.any_value("file_bytes") - F.sum("n_bytes")
    whole = blocks.groupBy("file").agg(
        rest.alias("rest"), F.sum("n_lines").alias("n_lines"), F.bool_or("has_cr").alias("has_cr"),
        F.bool_or("has_quote").alias("has_quote"), F.bool_and("valid").alias("valid"),
        F.bool_or("undefined").alias("undefined"), F.max_by("last_cr", "blk").alias("last_cr"),
    )
    bom = F.col("rest") >= 2
    ends_nl = F.col("rest").isin(0, 3) | F.col("last_cr")
    return whole.select(
        "file", "n_lines", "has_cr", "has_quote", bom.alias("bom"), ends_nl.alias("ends_nl"),
        X.encoding_label("valid", "undefined", bom).alias("encoding"),
    )


def number_blocks(blocks: DataFrame) -> DataFrame:
    """Add ``ln_before``, the lines of a file above each block (one row per block)."""
    above = Window.partitionBy("file").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("ln_before", F.coalesce(F.sum("n_lines").over(above), F.lit(0)))


def with_facts(rows: DataFrame, facts: DataFrame, n_facts: int, keys: Sequence[str] = ("file", "blk")) -> DataFrame:
    """Join facts, which have no text but the keys and labels, to rows.

    Counted small they are broadcast, so the rows stay where they are.
    """
    if n_facts <= BROADCAST_ROWS:
        return rows.join(F.broadcast(facts), list(keys))
    if n_facts > NARROW_ROWS:
        return rows.join(facts.hint("shuffle_hash"), list(keys))
    hashes = {"_h1": F.xxhash64(*keys), "_h2": F.hash(*keys)}
    side = facts.withColumns(hashes).drop(*keys)
    return rows.withColumns(hashes).join(F.broadcast(side), list(hashes)).drop(*hashes)


def without_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of all but the given files; a short list is broadcast."""
    n = files.count()
    if n == 0:
        return rows
    side = F.broadcast(files.select("file")) if n <= BROADCAST_ROWS else files.select("file")
    return rows.join(side, "file", "left_anti")


SALTS = 16


def with_file_facts(rows: DataFrame, facts: DataFrame, n_files: int) -> DataFrame:
    """Join per-file facts to rows with a ``_row_id``.

    Too many files for a broadcast are joined by (file, salt), so that a file
    holding a large share of the rows is spread over several tasks.
    """
    if n_files <= BROADCAST_ROWS:
        return rows.join(F.broadcast(facts), "file")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_row_id"), F.lit(SALTS)).cast("int"))
    copies = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies.hint("shuffle_hash"), ["file", "_salt"]).drop("_salt")


def _first_line_prefix(encoding: Column, bom: Column) -> Column:
    """The three bytes of a BOM are text when the file is not UTF-8."""
    return F.when(bom & ~F.startswith(encoding, F.lit("utf-8")), F.lit("ï»¿")).otherwise(F.lit(""))


def lines(segments: DataFrame, blocks: DataFrame, n_blocks: int, any_inner_cr: bool, keep: Sequence[str] = (),
          quoted_only: bool = False) -> DataFrame:
    """(file, blk, ln, text, *keep): decoded lines, numbered from 0 per file.

    ``blocks`` holds block facts, the file's ``encoding`` and ``bom``, and the
    columns to keep.  Numbers need no shuffle: a segment's place in its block
    is its id minus the block's first id.  Only blocks with lone CRs, where a
    segment holds several lines, are ordered by a window.  ``quoted_only``
    keeps lines that hold a quote, dropping others before they are decoded.
    """
    used = ["file", "blk", "mid0", "ln_before", "inner_cr", "encoding", "bom", *keep]
    joined = with_facts(segments.select("file", "blk", "mid", "raw"), blocks.select(used), n_blocks)
    first = (F.col("ln_before") == 0) & (F.col("mid") == F.col("mid0"))
    decoded = F.concat(
        F.when(first, _first_line_prefix(F.col("encoding"), F.col("bom"))).otherwise(F.lit("")),
        X.decode_as("raw", F.col("encoding")),
    )
    cut = joined.withColumn("_t", decoded).withColumn(
        "_t", F.when(F.endswith("_t", F.lit("\r")), F.substring(F.col("_t"), F.lit(1), F.length("_t") - 1)).otherwise(F.col("_t"))
    )
    plain = cut.filter(~F.col("inner_cr")) if any_inner_cr else cut
    if quoted_only:
        plain = plain.filter(F.contains("raw", F.unhex(F.lit("22"))))
    out = ["file", "blk", "ln", "text", *keep]
    numbered = plain.withColumn("ln", F.col("ln_before") + F.col("mid") - F.col("mid0")).withColumn("text", F.col("_t"))
    if not any_inner_cr:
        return numbered.select(out)
    order = Window.partitionBy("file", "blk").orderBy("mid", "_sub")
    split = cut.filter("inner_cr").select(
        "file", "blk", "mid", "ln_before", *keep, F.posexplode(F.split("_t", "\r")).alias("_sub", "text"))
    return numbered.select(out).unionByName(
        split.withColumn("ln", F.col("ln_before") + F.row_number().over(order) - 1)
        .filter(F.contains("text", F.lit('"')) if quoted_only else F.lit(True)).select(out))


def _gathered(first_lines: DataFrame) -> DataFrame:
    """(file, texts): the lines of each file in order; bounded by the caller."""
    listed = first_lines.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ln", "text"))).alias("_l"))
    return listed.select("file", F.transform("_l", lambda r: r.getField("text")).alias("texts"))


def heads(segments: DataFrame, blocks: DataFrame, n_blocks: int, any_inner_cr: bool, head_blk: int, ws: Workspace) -> DataFrame:
    """(file, head_lines, sample_lines): the first lines of each file.

    The first 60 lines nearly always hold the whole detection sample.  Only
    files in which they do not (mostly blank lines) are read further, up to
    the sample's 16,384 characters.  ``head_blk`` is the last block any of
    this can reach, so the scan skips the others.
    """
    scan = segments.filter(F.col("blk") <= head_blk)
    top = lines(scan, blocks.filter(F.col("ln_before") < K.HEADER_SCAN_LINES), n_blocks, any_inner_cr)
    short = _gathered(top.filter(F.col("ln") < K.HEADER_SCAN_LINES)).withColumn("_text", F.array_join("texts", "\n"))
    sampled = short.withColumn("sample_lines", sample_lines("_text")).select(
        "file", F.col("texts").alias("head_lines"), "sample_lines",
        ((F.size("texts") == K.HEADER_SCAN_LINES) & (F.size("sample_lines") < K.SAMPLE_LINES)
         & (F.length("_text") < K.SAMPLE_CHARS)).alias("deep"))
    sampled = ws.save(sampled, "heads")
    deep = sampled.filter("deep").select("file")
    if deep.isEmpty():
        return sampled.drop("deep")
    near = blocks.filter(F.col("ln_before") < K.SAMPLE_CHARS).join(deep, "file", "left_semi")
    first = lines(scan, near, n_blocks, any_inner_cr).filter(F.col("ln") < K.SAMPLE_CHARS)
    above = Window.partitionBy("file").orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    placed = first.withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(above), F.lit(0)))
    longer = _gathered(placed.filter(F.col("start") < K.SAMPLE_CHARS)).select(
        "file", sample_lines(F.array_join("texts", "\n")).alias("longer"))
    return sampled.join(longer, "file", "left").select(
        "file", "head_lines", F.coalesce("longer", "sample_lines").alias("sample_lines"))


def binary_files(segments: DataFrame, blocks: DataFrame, n_blocks: int, head_blk: int) -> DataFrame:
    """(file) of files with a NUL among their first bytes.

    Only blocks of files that hold a NUL at all are read to find where it is.
    """
    suspects = blocks.filter("has_nul").select("file").distinct()
    near = blocks.filter(F.col("ln_before") < K.BINARY_SNIFF_BYTES).join(suspects, "file", "left_semi")
    joined = with_facts(segments.filter(F.col("blk") <= head_blk), near.select("file", "blk", "mid0", "ln_before", "bom"), n_blocks)
    first = joined.filter(F.col("mid") - F.col("mid0") < K.BINARY_SNIFF_BYTES)
    above = Window.partitionBy("file").orderBy("blk", "mid").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("raw") + 1).over(above), F.lit(0)) + F.when(F.col("bom"), 3).otherwise(0)
    # The first NUL decides; later ones lie behind it.
    at = F.instr(X.latin1_text("raw"), "\u0000")
    placed = first.withColumn("start", start).filter(F.col("start") < K.BINARY_SNIFF_BYTES)
    return placed.filter((at > 0) & (F.col("start") + at <= K.BINARY_SNIFF_BYTES)).select("file").distinct()
