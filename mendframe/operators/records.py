"""Records of files that are cut into blocks.

A line acts on the open/closed quote state as a function: it fixes the state
(constant), flips it, or leaves it.  Such functions compose, so each block is
summarised on its own, the summaries (one row per block) are combined in file
order, and the result is given back to the blocks.  Only lines with a quote
take part, as narrow rows; blocks that stay closed throughout never leave
their scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.files import with_facts, without_files
from ..sources.workspace import Workspace



def in_block() -> Window:
    return Window.partitionBy("file", "blk").orderBy("ln")


def block_order() -> Window:
    """Blocks of a file in order: one row per input split."""
    return Window.partitionBy("file").orderBy("blk")


def quote_effects(quoted: DataFrame) -> DataFrame:
    """What each line with a quote does, as a narrow table.

    ``odd``: it switches the quote parity; ``closed_start`` and ``open_start``:
    whether a field is open after it when none / one was open before.
    """
    return quoted.select(
        "file", "blk", "ln", (F.col("ln") >= F.col("header_ln")).alias("in_body"),
        (X.count_char("text", '"') % 2 == 1).alias("odd"),
        X.ends_open("text", F.col("delimiter")).alias("closed_start"),
        X.ends_open(F.concat(F.lit('"'), "text"), F.col("delimiter")).alias("open_start"),
    )


def quote_states(effects: DataFrame) -> DataFrame:
    """(file, blk, ln, fixed, state): the composed effect of a block up to a line.

    ``fixed`` tells that the state no longer depends on how the block started;
    otherwise ``state`` is 1 when the start state is flipped.
    """
    acting = effects.filter("in_body AND (closed_start OR NOT open_start)")  # others leave the state
    fixes = F.col("closed_start") == F.col("open_start")
    marked = acting.select(
        "file", "blk", "ln", F.when(fixes, F.col("closed_start").cast("int")).alias("const"),
        F.when(fixes, 0).otherwise(1).alias("flip"),
    )
    return _running(marked, in_block()).select("file", "blk", "ln", "fixed", "state")


def _running(df: DataFrame, window) -> DataFrame:
    """Add ``fixed`` and ``state`` after each row from ``const`` and ``flip``."""
    counted = df.withColumn("_flips", F.sum("flip").over(window))
    last = F.last(F.when(F.col("const").isNotNull(), F.struct("const", "_flips")), ignorenulls=True).over(window)
    held = counted.withColumn("_last", last)
    state = (F.coalesce(F.col("_last.const"), F.lit(0)) + F.col("_flips") - F.coalesce(F.col("_last._flips"), F.lit(0))) % 2
    return held.withColumn("fixed", F.col("_last").isNotNull()).withColumn("state", state).drop("_flips", "_last")


def block_states(states: DataFrame, blocks: DataFrame) -> DataFrame:
    """(file, blk, open_in): the quote state each block starts with."""
    effect = states.groupBy("file", "blk").agg(F.max_by(F.struct("fixed", "state"), "ln").alias("e"))
    ordered = blocks.select("file", "blk").join(effect, ["file", "blk"], "left").select(
        "file", "blk", F.when(F.col("e.fixed"), F.col("e.state")).alias("const"),
        F.when(F.col("e.fixed"), 0).otherwise(F.coalesce(F.col("e.state"), F.lit(0))).alias("flip"),
    )
    after = _running(ordered, block_order())
    return after.select("file", "blk", F.coalesce(F.lag("state").over(block_order()), F.lit(0)).alias("open_in"))


def resolve(states: DataFrame, starts: DataFrame, n_blocks: int) -> DataFrame:
    """(file, blk, ln, before, after): true states around each acting line."""
    joined = with_facts(states, starts, n_blocks)
    after = F.when(F.col("fixed"), F.col("state")).otherwise((F.col("state") + F.col("open_in")) % 2)
    known = joined.withColumn("after", after)
    before = F.coalesce(F.lag("after").over(in_block()), F.col("open_in"))
    return known.withColumn("before", before).select("file", "blk", "ln", "before", "after")


def open_blocks(resolved: DataFrame, starts: DataFrame) -> DataFrame:
    """(file, blk, open_in, carry_ln, touched): where multi-line records run.

    ``carry_ln`` is the first line of a record that is open when the block starts.
    """
    opener = resolved.filter("before = 0 AND after = 1").groupBy("file", "blk").agg(F.max("ln").alias("opener"))
    ordered = starts.join(opener, ["file", "blk"], "left")
    above = block_order().rowsBetween(Window.unboundedPreceding, -1)
    return ordered.select(
        "file", "blk", "open_in", F.last("opener", ignorenulls=True).over(above).alias("carry_ln"),
        ((F.col("open_in") == 1) | F.col("opener").isNotNull()).alias("touched"),
    )


RECORD = ["file", "blk", "ln", "n_phys", "text", "delimiter"]

# Rows (some 30 bytes) of line-to-record tables up to which they are broadcast, so that lines stay in place.
BROADCAST_SPAN_ROWS = 2_000_000


def record_spans(resolved: DataFrame) -> DataFrame:
    """(file, start, end): the lines of each multi-line record, from the narrow table of acting lines.

    A record opens at a line that leaves a field open when none was, and ends
    at the next acting line that closes it, in its block or a later one
    (running minima over rows in reverse order, one row per line or block).
    ``end`` is null when the record is still open at the end of the file.
    """
    later = Window.partitionBy("file", "blk").orderBy(F.desc("ln")).rowsBetween(Window.unboundedPreceding, -1)
    closing = F.when(F.col("after") == 0, F.col("ln"))
    openers = resolved.withColumn("end_in", F.min(closing).over(later)).filter("before = 0 AND after = 1")
    per_block = resolved.groupBy("file", "blk").agg(F.min(closing).alias("first_close"))
    after_block = Window.partitionBy("file").orderBy(F.desc("blk")).rowsBetween(Window.unboundedPreceding, -1)
    next_close = per_block.select("file", "blk", F.min("first_close").over(after_block).alias("end_later"))
    return openers.join(next_close, ["file", "blk"], "left").select(
        "file", F.col("ln").alias("start"), F.coalesce("end_in", "end_later").alias("end"))


def one_line_records(lines: DataFrame) -> DataFrame:
    return lines.select("file", "blk", "ln", F.lit(1).cast("bigint").alias("n_phys"), "text", "delimiter")


def read_records(lines: DataFrame, effects: DataFrame | None, blocks: DataFrame, n_blocks: int, ws: Workspace,
                 max_record_chars: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(records, oversized files).

    ``lines`` has (file, blk, ln, text, delimiter) from the header line on,
    ``effects`` is the table of :func:`quote_effects` (None without quotes), ``blocks`` the blocks in play with ``open_tail_nl``: whether a field still
    open at the end of the file keeps a final newline.  A record longer than
    ``max_record_chars`` (if given) is never gathered; its file is reported instead.
    """
    if effects is None:
        return one_line_records(lines), None
    states = ws.save(quote_states(effects), "quote_states")
    starts = ws.save(block_states(states, blocks), "block_states")
    resolved = ws.save(resolve(states, starts, n_blocks), "quote_lines")
    opened = ws.save(open_blocks(resolved, starts), "open_blocks")
    if opened.filter("touched").isEmpty():
        return one_line_records(lines), None

    calm = one_line_records(with_facts(lines, opened.filter("NOT touched").select("file", "blk"), n_blocks))
    busy = with_facts(lines, opened.filter("touched").join(blocks.select("file", "blk", "open_tail_nl"), ["file", "blk"]).select(
        "file", "blk", "open_tail_nl"), n_blocks)
    spans = ws.save(record_spans(resolved), "record_spans")
    # lines of closed multi-line records by number, narrow; a record open at the end runs to the end of its file
    inside = ws.save(spans.filter(F.col("end").isNotNull()).select(
        "file", F.explode(F.sequence("start", "end")).alias("ln"), F.col("start").alias("rec_ln")), "span_lines")
    tails = spans.filter(F.col("end").isNull()).select("file", F.col("start").alias("tail_ln"))
    n_tails = tails.count()
    tails = F.broadcast(tails) if n_tails <= BROADCAST_SPAN_ROWS else tails
    n_inside = inside.count()
    inside = F.broadcast(inside) if n_inside <= BROADCAST_SPAN_ROWS else inside
    tagged = busy.join(inside, ["file", "ln"], "left").join(tails, "file", "left")
    open_end = F.coalesce(F.col("ln") >= F.col("tail_ln"), F.lit(False))
    placed = tagged.select("file", "blk", "ln", "text", "delimiter", "open_tail_nl", open_end.alias("open_end"),
                           F.coalesce("rec_ln", F.when(open_end, F.col("tail_ln"))).alias("rec_ln"))
    single = one_line_records(placed.filter(F.col("rec_ln").isNull()))
    parts = placed.filter(F.col("rec_ln").isNotNull())
    oversized, fitting = None, parts
    if max_record_chars is not None:
        sizes = parts.groupBy("file", "rec_ln").agg(F.sum(F.length("text") + 1).alias("chars"))
        oversized = ws.save(sizes.filter(F.col("chars") > max_record_chars).select("file").distinct(), "oversized")
        fitting = without_files(parts, oversized)
    joined = fitting.groupBy("file", F.col("rec_ln").alias("ln")).agg(
        F.min("blk").alias("blk"), F.count(F.lit(1)).alias("n_phys"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "text"))), lambda r: r.getField("text")), "\n").alias("text"),
        F.any_value("delimiter").alias("delimiter"),
        F.max_by(F.col("open_tail_nl") & F.col("open_end"), "ln").alias("tail"),
    ).withColumn("text", F.when(F.col("tail"), F.concat("text", F.lit("\n"))).otherwise(F.col("text")))
    return calm.select(RECORD).unionByName(single.select(RECORD)).unionByName(joined.select(RECORD)), oversized


def stitch_facts(effects: DataFrame | None, blocks: DataFrame, files: DataFrame, n_blocks: int) -> DataFrame:
    """Quote-parity statistics per file.

    Only lines with an odd number of quotes switch the parity; in order they
    open and close in turn, and each pair is one record.
    """
    physical = (F.col("n_lines") + F.col("ends_nl").cast("int")).alias("physical_lines")
    whole = files.select("file", physical)
    if effects is None:
        return whole.select("file", "physical_lines", F.col("physical_lines").alias("logical_lines"),
                            F.lit(0).cast("bigint").alias("stitched_records"), F.lit(1).cast("bigint").alias("max_physical_per_record"))
    odd = effects.filter("odd").select("file", "blk", "ln")
    per_block = odd.groupBy("file", "blk").agg(F.count(F.lit(1)).alias("n"), F.min("ln").alias("first"))
    spread = blocks.select("file", "blk").join(per_block, ["file", "blk"], "left").join(whole, "file")
    above = block_order().rowsBetween(Window.unboundedPreceding, -1)
    below = block_order().rowsBetween(1, Window.unboundedFollowing)
    context = spread.select(
        "file", "blk", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_before"),
        F.coalesce(F.min("first").over(below), F.col("physical_lines") - 1).alias("next_ln"),
    )
    ranked = with_facts(odd, context, n_blocks)
    nth = F.col("n_before") + F.row_number().over(in_block())
    end = F.coalesce(F.lead("ln").over(in_block()), F.col("next_ln"))
    spans = ranked.select("file", nth.alias("nth"), (end - F.col("ln") + 1).alias("span")).filter("nth % 2 = 1 AND span > 1")
    merged = spans.groupBy("file").agg(
        F.count(F.lit(1)).alias("stitched"), F.max("span").alias("longest"), F.sum(F.col("span") - 1).alias("saved"))
    return whole.join(merged, "file", "left").select(
        "file", "physical_lines", (F.col("physical_lines") - F.coalesce("saved", F.lit(0))).alias("logical_lines"),
        F.coalesce("stitched", F.lit(0)).alias("stitched_records"),
        F.coalesce("longest", F.lit(1)).alias("max_physical_per_record"))
