"""The whole repair of many files as a few Spark jobs.

scan -> block facts -> file profile -> records -> fields -> clean rows.

The raw segments are written once and everything later reads that table.
Small tables (facts per block and per file) steer the plan; all row data
stays in Spark.  Columns of one file are in ``RepairResult.table``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import labels as L
from ..functions import text as X
from ..operators import cells as C
from ..operators import changelog as G
from ..operators import parse as P
from ..operators import preview as V
from ..operators import profile as PR
from ..operators import records as R
from ..sources import files as S
from ..sources import sinks
from ..sources.admission import admission_verdict
from ..sources.workspace import Workspace


# Up to this many (file, row id) pairs, some 150 bytes each, are broadcast; it only picks the join.
BROADCAST_IDS = 100_000


@dataclass(frozen=True)
class Limits:
    """Admission limits; None switches a limit off.

    ``max_record_chars`` bounds what one record may hold in memory; a file
    with a longer record (an unclosed quote) is rejected as a whole.
    """

    max_bytes: int | None = None
    max_rows: int | None = None
    max_cols: int | None = None
    max_record_chars: int | None = None


SERVICE_LIMITS = Limits(**K.SERVICE_LIMITS)


@dataclass
class ResultView:
    """summary: one row; first, last, repaired: rows under the file's header."""

    summary: DataFrame
    first: DataFrame
    last: DataFrame
    repaired: DataFrame


@dataclass
class RepairResult:
    """rows: (file, _row_id, cells, _repaired); files: one report row per file;
    rejected: (file, name, reason); examples: near-duplicate pairs;
    repaired: (file, _row_id) of all rows whose width was repaired;
    mode: how near-duplicates were treated ('' if not at all)."""

    rows: DataFrame
    files: DataFrame
    rejected: DataFrame
    examples: DataFrame
    repaired: DataFrame
    bronze: DataFrame
    workspace: Workspace
    mode: str = ""

    def release(self) -> None:
        """Remove the tables of the run; the result can't be read any more."""
        self.workspace.release()

    def view(self, file: str, n: int = K.PREVIEW_ROWS) -> ResultView:
        """The manifest row of one file with its labels, and previews of its rows."""
        rows = self.table(file)
        row = self.manifest().filter(F.col("job_id") == file)
        labels = L.badges("changelog")
        return ResultView(
            summary=row.withColumns({k: labels[k] for k in ("encoding_label", "numbers_label", "header_label")}).withColumn(
                "delimiter_label", L.delimiter_label(F.col("detected_delimiter"))),
            first=V.head(rows, "_row_id", n), last=V.tail(rows, "_row_id", n), repaired=V.repaired_rows(rows, "_row_id", "_repaired", n))

    def table(self, file: str) -> DataFrame:
        """The rows of one file under its clean header, numeric columns as double."""
        info = self.files.filter(F.col("file") == file).select("header", "numeric").first()
        if info is None:
            raise KeyError(file)
        numeric = set(info["numeric"] or [])
        columns = []
        for i, name in enumerate(info["header"]):
            cell = F.get("cells", F.lit(i))
            columns.append((F.nullif(cell, F.lit("")).cast("double") if i in numeric else cell).alias(name))
        return self.rows.filter(F.col("file") == file).select("_row_id", "_repaired", *columns)

    def changelog(self) -> DataFrame:
        return G.changelog_rows(self.files)

    def manifest(self) -> DataFrame:
        """Manifest rows, one per file, with its near-duplicate examples as JSON."""
        pair = F.struct("kept_id", "removed_id", F.to_json(F.struct("kept", "removed")).alias("json"))
        shown = self.examples.groupBy("file").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))  # a few for each file
        listed = shown.select("file", F.transform("pairs", lambda p: p["json"]).alias("near_dupe_examples"))
        f = self.files.join(listed, "file", "left").select(
            F.col("file").alias("job_id"), "rows", F.col("width").cast("bigint").alias("cols"), "changelog",
            ((F.col("too_long") > 0) | (F.col("too_short") > 0)).alias("import_warning"),
            (F.col("too_long") + F.col("too_short")).alias("repaired_rows"), F.lit(self.mode).alias("near_dupes_mode"), "near_dupe_examples",
            F.filter(F.transform("header", lambda h, i: F.when(F.get("ignored", i), h)), lambda h: h.isNotNull()).alias("ignored_cols"),
            F.col("near_dupes").alias("near_dupes_count"), F.col("delimiter").alias("detected_delimiter"),
            L.output_name(F.col("delimiter")).alias("out_file"),
            F.col("file").alias("original_file"), F.col("name").alias("original_filename"), "header_debug_log")
        return sinks.manifest_rows(f)

    def write_delimited(self, path: str) -> None:
        """One folder per file; its part files in name order are the cleaned file.

        Rows are range-partitioned by (file, row), so a large file becomes many
        parts; the header is the first line of the first part.
        """
        lines = self.rows.select("file", "_row_id", "cells").unionByName(
            self.files.select("file", F.lit(-1).cast("bigint").alias("_row_id"), F.col("header").alias("cells")))
        n = self.files.count()
        with_d = S.with_file_facts(lines, self.files.select("file", "delimiter", "name"), n)
        rendered = with_d.select(
            F.concat_ws("-", F.substring(F.sha2("file", 256), 1, 12), "name").alias("source"), "_row_id",
            X.render_row("cells", F.col("delimiter")).alias("value"))
        (rendered.repartitionByRange("source", "_row_id").sortWithinPartitions("source", "_row_id")
            .select("source", "value").write.partitionBy("source").option("lineSep", "\n").text(path))


def _without_rows(rows: DataFrame, keys: DataFrame, groups: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """Rows that are the first of their group; keys and groups are written tables.

    The dropped (file, row id) pairs are found among the narrow keys and taken
    out by an anti join; their number only picks the kind of join.
    """
    repeated = ws.save(groups.filter("n > 1").select("key", "kept_id"), f"{name}_repeated")
    n = repeated.count()
    if n == 0:
        return rows
    dropped = ws.save(C.duplicate_rows(keys, F.broadcast(repeated) if n <= BROADCAST_IDS else repeated), f"{name}_dropped")
    dropped = F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped.hint("shuffle_hash")
    return rows.join(dropped, ["file", "_row_id"], "left_anti")


def repair(spark: SparkSession, paths: str | Sequence[str], near_dupes: str | None = None,
           normalize_numbers: bool = False, limits: Limits = Limits(), strict_compat: bool = False,
           blank_is_empty: bool | None = None, respect_selected_header: bool | None = None,
           work_dir: str | None = None) -> RepairResult:
    """Repair and clean delimited text files.

    near_dupes: None, 'preview' (count only) or 'remove'.  strict_compat keeps
    blank rows that are only padded and adds generated headers even when the
    first line was picked as header; both can be set on their own.
    Files are cut at LF; a file whose facts show CR line ends (or a segment
    too long to keep) is read again, cut at its own separator, so large files
    of CR line ends are read in parallel with exact BOM and line-end facts.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if near_dupes not in (None, "preview", "remove"):
        raise ValueError("near_dupes must be None, 'preview' or 'remove'")
    blank_is_empty = not strict_compat if blank_is_empty is None else blank_is_empty
    respect = not strict_compat if respect_selected_header is None else respect_selected_header
    ws = Workspace(spark, work_dir)

    # 1. Listing: size and extension need no content.
    listed = ws.save(S.list_files(spark, paths).withColumn(
        "reason", admission_verdict(name="name", n_bytes="n_bytes", max_bytes=limits.max_bytes)), "listed")

    # 2. Raw segments, written once; files that the LF scan can't serve are read again at their own separator.
    segments = S.without_files(S.read_segments(spark, paths, "\n", S.MAX_SEGMENT_BYTES), listed.filter("reason IS NOT NULL"))
    bronze = ws.save(segments, "bronze")
    blocks = ws.save(S.number_blocks(S.block_facts(bronze)), "blocks")
    again = ws.save(S.second_scan(listed, blocks), "second_scan")
    by_sep = {r["sep"]: r["files"] for r in again.groupBy("sep").agg(F.collect_list("file").alias("files")).collect()}
    if by_sep:
        cut = [S.read_segments(spark, [S.readable(f) for f in files], sep) for sep, files in sorted(by_sep.items())]
        cut = ws.save(cut[0] if len(cut) == 1 else cut[0].unionByName(cut[1]), "bronze_cut")
        bronze = ws.save(S.without_files(bronze, again).unionByName(cut), "bronze_all")
        blocks = ws.save(S.without_files(blocks, again).unionByName(S.number_blocks(S.block_facts(cut))), "blocks_all")
    files = ws.save(S.file_facts(blocks), "files")
    facts = blocks.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or("inner_cr"), F.lit(False)).alias("inner_cr"),
        F.coalesce(F.bool_or("has_quote"), F.lit(False)).alias("quote"),
        F.coalesce(F.bool_or("has_nul"), F.lit(False)).alias("nul"),
        F.coalesce(F.max(F.when(F.col("ln_before") < K.SAMPLE_CHARS, F.col("blk"))), F.lit(0)).alias("head_blk")).first()
    n_blocks, any_inner_cr, head_blk = facts["n"], facts["inner_cr"], facts["head_blk"]

    # 3. Profile: one row per file.
    coded = blocks.join(files.select("file", "encoding", "bom", "ends_nl"), "file")
    head = S.heads(bronze, coded, n_blocks, any_inner_cr, head_blk, ws)
    if facts["nul"]:
        nul = S.binary_files(bronze, coded, n_blocks, head_blk).withColumn("binary", F.lit(True))
        head = head.join(nul, "file", "left").withColumn("binary", F.coalesce("binary", F.lit(False)))
    else:
        head = head.withColumn("binary", F.lit(False))
    profiled = PR.with_synthetic_header(PR.with_header(PR.with_delimiter(head)), respect)
    kept = ["file", "binary", "delimiter", "choice", "modal", "header", "header_ln", "stripped", "header_log", "synthetic", "counts"]
    profile = ws.save(profiled.select(kept), "profile").withColumnRenamed("header", "header_choice")

    tail = F.col("synthetic").isNotNull() | (F.col("ends_nl") & (
        F.coalesce(F.col("header_choice.status").isin("unsure", "too_deep"), F.lit(False)) | (F.size("counts") == 0)))
    planned = coded.join(profile.filter("NOT binary"), "file").withColumn("open_tail_nl", tail)
    planned = ws.save(planned.select(
        "file", "blk", "mid0", "ln_before", "inner_cr", "encoding", "bom", "delimiter", "header_ln", "open_tail_nl"), "plan")

    # 4. Records from the header line on, and parity statistics of whole files.
    keep = ["delimiter", "header_ln"]
    effects = None
    if facts["quote"]:
        quoted = S.lines(bronze, planned, n_blocks, any_inner_cr, keep, quoted_only=True)
        effects = ws.save(R.quote_effects(quoted), "quote_effects")
    stitch = R.stitch_facts(effects, planned, files, n_blocks)
    body = S.lines(bronze, planned, n_blocks, any_inner_cr, keep).filter(F.col("ln") >= F.col("header_ln")).drop("header_ln")
    records, oversized = R.read_records(body, effects, planned, n_blocks, ws, limits.max_record_chars)

    # 5. Headers: the first record, or generated names.
    n_files = files.count()
    near = records.filter(F.col("blk") <= head_blk).withColumnRenamed("ln", "_row_id")
    first = S.with_file_facts(near, profile.select("file", "header_ln"), n_files).filter(F.col("_row_id") == F.col("header_ln"))
    named = profile.filter("NOT binary").join(
        first.select("file", X.fields("text", F.col("delimiter")).alias("own")), "file", "left")
    headers = ws.save(C.header_rows(named.select("file", "synthetic", "header_ln", "own"),
                                    F.coalesce("synthetic", "own")), "headers")
    wide = None if limits.max_cols is None else headers.filter(F.col("width") > limits.max_cols)

    # 6. Fields, whitespace, duplicates.
    first_data = F.when(F.col("synthetic").isNotNull(), F.col("header_ln")).otherwise(F.col("header_ln") + 1)
    placed = planned.select("file", "blk").join(
        headers.select("file", "width", first_data.alias("first_data")), "file")
    rows = S.with_facts(records, placed, n_blocks).filter(F.col("ln") >= F.col("first_data"))
    for bad in (oversized, wide):
        rows = rows if bad is None else S.without_files(rows, bad)
    parsed = P.with_conformed(rows, F.col("text"), F.col("delimiter"), F.col("width"))
    whole = ws.save(C.trimmed_rows(parsed, blank_is_empty), "trimmed")
    exact = ws.save(C.exact_keys(whole), "exact_keys")
    exact_groups = ws.save(C.key_groups(exact), "exact_groups")
    counts = ws.save(C.clean_counts(whole, exact_groups), "counts")
    cleaned = _without_rows(whole.filter("NOT is_empty"), exact, exact_groups, ws, "exact")
    repaired = whole.filter("_repaired").select("file", "_row_id")

    # 7. Numbers.
    data = cleaned.select("file", "_row_id", "_repaired", "cells")
    numeric = None
    if normalize_numbers:
        found = headers.select("file").join(C.numeric_positions(data), "file", "left")
        numeric = ws.save(found.select(
            "file", F.coalesce("numeric", F.array().cast("array<int>")).alias("numeric"), "lossy_cells"), "numeric")
        data = C.convert_numbers(S.with_file_facts(data, numeric.select("file", "numeric"), n_files)).drop("numeric")

    # 8. Near-duplicates.
    none = F.lit(0).cast("bigint")
    examples = data.limit(0).select("file", none.alias("kept_id"), none.alias("removed_id"), F.col("cells").alias("kept"), F.col("cells").alias("removed"))
    dupes = None
    if near_dupes:
        flagged = S.with_file_facts(data, headers.select("file", "ignored"), n_files)
        keys = ws.save(C.near_duplicate_keys(flagged), "near_keys")
        groups = ws.save(C.key_groups(keys), "near_groups")
        dupes = groups.groupBy("file").agg(F.sum(F.col("n") - 1).alias("near_dupes"))
        pairs = ws.save(C.near_duplicate_pairs(keys, groups, n_files), "near_pairs")
        # the few rows that are shown are picked by their ids; rows themselves are never broadcast by a hint
        shown = pairs.select("file", F.explode(F.array("kept_id", "removed_id")).alias("_row_id")).distinct()
        shown = F.broadcast(shown) if n_files * K.NEAR_DUP_EXAMPLES <= S.BROADCAST_ROWS else shown
        shown = ws.save(data.select("file", "_row_id", "cells").join(shown, ["file", "_row_id"]), "near_shown")
        examples = pairs.join(shown.select("file", F.col("_row_id").alias("kept_id"), F.col("cells").alias("kept")), ["file", "kept_id"]).join(
            shown.select("file", F.col("_row_id").alias("removed_id"), F.col("cells").alias("removed")), ["file", "removed_id"])
        examples = examples.select("file", "kept_id", "removed_id", "kept", "removed")
        if near_dupes == "remove":
            data = _without_rows(data, keys, groups, ws, "near")

    # 9. Report.
    report = (
        headers.drop("own", "synthetic", "header_ln")
        .join(profile.drop("counts", "binary"), "file").join(files, "file").join(stitch, "file")
        .join(listed.select("file", "name", "n_bytes"), "file").join(counts, "file", "left")
        .join(dupes if dupes is not None else files.select("file", F.lit(0).cast("bigint").alias("near_dupes")), "file", "left")
        .join(numeric if numeric is not None else files.select(
            "file", F.array().cast("array<int>").alias("numeric"), F.lit(0).cast("bigint").alias("lossy_cells")), "file", "left")
    )
    zero = ["rows_in", "trimmed", "too_long", "too_short", "empty_rows", "duplicate_rows", "rows", "near_dupes", "lossy_cells"]
    report = report.withColumns({
        **{c: F.coalesce(c, F.lit(0)).cast("bigint") for c in zero},
        "numeric": F.coalesce("numeric", F.array().cast("array<int>"))})
    if near_dupes == "remove":
        report = report.withColumn("rows", F.col("rows") - F.col("near_dupes"))

    # 10. Rejections found in the content.
    too_long = oversized.withColumn("_over", F.lit(True)) if oversized is not None else files.limit(0).select("file", F.lit(True).alias("_over"))
    verdict = admission_verdict(
        binary=F.coalesce("binary", F.lit(False)), n_rows="rows_in", is_empty=F.coalesce("width", F.lit(-1)) < 0, n_cols="width",
        max_rows=limits.max_rows, max_cols=limits.max_cols)
    content = (
        listed.filter("reason IS NULL").select("file", "name")
        .join(profile.select("file", "binary"), "file", "left").join(headers.filter("raw_header IS NOT NULL").select("file", "width"), "file", "left")
        .join(counts.select("file", "rows_in"), "file", "left").join(too_long, "file", "left")
        .withColumn("reason", F.when(F.col("_over"), F.lit("record_too_long")).otherwise(verdict))
        .filter("reason IS NOT NULL").select("file", "name", "reason"))
    rejected = ws.save(listed.filter("reason IS NOT NULL").select("file", "name", "reason").unionByName(content), "rejected")
    report = ws.save(S.without_files(G.with_changelog(report, normalize_numbers, near_dupes or ""), rejected), "report")
    return RepairResult(
        rows=S.without_files(data.select("file", "_row_id", "_repaired", "cells"), rejected), files=report, rejected=rejected,
        examples=S.without_files(examples, rejected), repaired=S.without_files(repaired, rejected), bronze=bronze, workspace=ws, mode=near_dupes or "")
