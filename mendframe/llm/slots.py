"""Sharding by fixed virtual slots (native).

Every row hashes into one of a few thousand slots, whose number never changes.
A small table maps slots to shards; rows follow their slot.  The map carries a
version and is only edited, never rebuilt: growing by a shard moves slots into
the new shard and leaves all others where they are.

Defined cases: a null text counts no bytes (8 in all) and has the checksum of
the empty text; a null doc_id is hashed like any value; rows that are equal in
doc_id and text share a slot and get consecutive places; an empty table gives
an empty result and a map of empty slots; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mendframe.functions.text import let
from mendframe.sources.workspace import Workspace

SLOTS = 4096
ROW_BYTES = 8


def slot_rows(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, vslot): narrow rows, one for each row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + F.lit(ROW_BYTES)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    # doc_id alone would put all rows without one into a single slot
    return rows.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int"))


def slot_totals(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(vslot, bytes, rows) of every slot, empty ones too; always ``slots`` rows."""
    totals = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(totals, "vslot", "left").select(
        "vslot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows"))


def _by_size(totals: DataFrame, *extra: str) -> DataFrame:
    """One row: all slots as an array, largest first (its length is the fixed number of slots)."""
    return totals.groupBy().agg(
        F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), "vslot", *extra))).alias("slots"))


def _added(loads: Column, at: Column, amount: Column) -> Column:
    return F.transform(loads, lambda v, i: v + F.when(i == at, amount).otherwise(F.lit(0).cast("long")))


def new_map(totals: DataFrame, shards: int) -> DataFrame:
    """(version, vslot, shard), version 1: each slot, largest first, goes to the shard with the fewest bytes so far."""
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"),
                     F.array().cast("array<struct<vslot:int,shard:int>>").alias("out"))

    def deal(acc: Column, slot: Column) -> Column:
        lightest = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        return let(lightest, lambda to: F.struct(
            _added(acc["loads"], to, -slot["neg"]).alias("loads"),
            F.concat(acc["out"], F.array(F.struct(slot["vslot"].alias("vslot"), to.alias("shard")))).alias("out")))

    dealt = _by_size(totals).select(F.explode(F.aggregate("slots", start, deal, lambda a: a["out"])).alias("m"))
    return dealt.select(F.lit(1).alias("version"), "m.vslot", "m.shard")


def grown_map(current: DataFrame, totals: DataFrame, shards: int) -> DataFrame:
    """The next version for ``shards`` + 1 shards: slots move from shards above the new mean into the new shard only."""
    old = totals.join(current.select("version", "vslot", "shard"), "vslot")
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards)), lambda s: F.aggregate(
        "slots", F.lit(0).cast("long"), lambda a, x: a + F.when(x["shard"] == s, -x["neg"]).otherwise(F.lit(0).cast("long"))))
    one = _by_size(old, "shard").withColumn("loads", loads)
    goal = F.aggregate("loads", F.lit(0).cast("long"), lambda a, x: a + x) / F.lit(shards + 1)
    one = one.withColumn("goal", goal)
    start = F.struct(F.col("loads").alias("loads"), F.array().cast("array<struct<vslot:int,shard:int>>").alias("out"))

    def edit(acc: Column, slot: Column) -> Column:
        size = -slot["neg"]
        moves = ((size > 0) & (F.element_at(acc["loads"], slot["shard"] + 1) - size >= F.col("goal"))
                 & (F.element_at(acc["loads"], shards + 1) + size <= F.col("goal")))
        return let(F.when(moves, F.lit(shards)).otherwise(slot["shard"]), lambda to: F.struct(
            _added(_added(acc["loads"], slot["shard"], -size), to, size).alias("loads"),
            F.concat(acc["out"], F.array(F.struct(slot["vslot"].alias("vslot"), to.alias("shard")))).alias("out")))

    moved = one.select(F.explode(F.aggregate("slots", start, edit, lambda a: a["out"])).alias("m"))
    version = current.agg(F.max("version")).first()[0] + 1
    return moved.select(F.lit(version).alias("version"), "m.vslot", "m.shard")


def placed(rows: DataFrame, totals: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` with shard, slot (place in the shard, without gaps) and map_version.

    Places are counted within a virtual slot and shifted by the rows of the
    shard's earlier slots, so no task sorts a whole shard.
    """
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = (totals.join(slot_map, "vslot")
              .select("vslot", "shard", F.col("version").alias("map_version"),
                      F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first")))
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("nth", F.row_number().over(within) - 1)
    # the map has a fixed number of rows, whatever the data
    return (numbered.join(F.broadcast(starts), "vslot")
            .withColumn("slot", (F.col("first") + F.col("nth")).cast("long")).drop("first", "nth"))


def shard(docs: DataFrame, shards: int, work: Workspace, slots: int = SLOTS) -> DataFrame:
    """Every row's shard under a new map of equal bytes; the map is stored as table ``slot_map`` of ``work``."""
    rows = work.save(slot_rows(docs, slots), "slot_rows")
    totals = work.save(slot_totals(rows, slots), "slot_totals")
    slot_map = work.save(new_map(totals, shards), "slot_map")
    return placed(rows, totals, slot_map)


def write_shards(docs: DataFrame, shards: int, work: Workspace, path: str, slots: int = SLOTS) -> DataFrame:
    """Write whole rows below ``path/shard=N`` by the stored map of ``work``; returns the map."""
    slot_map = work.spark.read.parquet(f"{work.path}/slot_map")
    text = F.coalesce(F.col("text"), F.lit(""))
    at = F.pmod(F.xxhash64(F.col("doc_id"), F.crc32(text.cast("binary")),
                           F.octet_length(text).cast("long") + F.lit(ROW_BYTES)), F.lit(slots)).cast("int")
    (docs.withColumn("vslot", at).join(F.broadcast(slot_map.select("vslot", "shard")), "vslot").drop("vslot")
     .write.mode("overwrite").partitionBy("shard").parquet(path))
    return slot_map
