"""Duplicate suppression and first-wins status on streams."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import IntegerType, LongType, StructType

from ..operators.events import nulls_last


def first_deliveries_stream(events: DataFrame, event_id: str | Sequence[str], ts: str, lateness: str = "10 minutes") -> DataFrame:
    """Each event id once; repeats within the watermark delay are dropped.

    The state is one entry per id, kept only for the delay.
    """
    ids = [event_id] if isinstance(event_id, str) else list(event_id)
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(ids)


def latest_latch(batch: DataFrame, known: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """New latch rows of a micro-batch: the first event of every key not latched yet.

    For use in ``foreachBatch``; ``known`` is the latch table so far.
    """
    rest = [c for c in batch.columns if c != key]
    first = batch.groupBy(key).agg(F.min_by(F.struct(*rest), nulls_last(order_by)).alias("_first"))
    return first.select(key, "_first.*").join(known.select(key), key, "left_anti")


class FirstWins(StatefulProcessor):
    """Per key, the first event by ``order`` (nulls last) of the first micro-batch that holds the key.

    The latched event is a ``ValueState``; once it exists, later events of the
    key are read and ignored, also after a restart from the checkpoint.  A
    key's rows of a batch arrive in pandas chunks and only the best one so far
    is held, so a key with a third of all events costs one row of memory.
    """

    def __init__(self, columns: Sequence[str], order: Sequence[str], schema: StructType):
        self.columns, self.order, self.schema = list(columns), list(order), schema

    def init(self, handle) -> None:
        self.first = handle.getValueState("first", self.schema)

    def _rank(self, row) -> tuple:
        return tuple(x for c in self.order for x in (row[c] is None, row[c] if row[c] is not None else 0))

    def _clean(self, row: dict) -> dict:
        out = {}
        for f in self.schema.fields:
            v = row[f.name]
            v = None if v is pd.NaT or (isinstance(v, float) and v != v) else v
            if v is not None and isinstance(f.dataType, (LongType, IntegerType)):
                v = int(v)
            out[f.name] = v
        return out

    def handleInputRows(self, key, rows, timerValues):
        if self.first.exists():
            for _ in rows:
                pass
            return
        best = None
        for chunk in rows:
            for row in chunk.to_dict("records"):
                row = self._clean(row)
                if best is None or self._rank(row) < self._rank(best):
                    best = row
        if best is None:
            return
        self.first.update(tuple(best[c] for c in self.columns))
        yield pd.DataFrame([{**dict(zip(self.key_names, key, strict=True)), **{c: best[c] for c in self.columns}}])

    def close(self) -> None:
        pass


def latch_stream(events: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """First-wins latch of a stream: one row per key, its first event's columns; stored as state, never revised."""
    spark = events.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").find("RocksDB") < 0:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                       "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    columns = [c for c in events.columns if c != key]
    payload = StructType([events.schema[c] for c in columns])
    processor = FirstWins(columns, order_by, payload)
    processor.key_names = [key]
    out = StructType([events.schema[key], *payload.fields])
    return events.groupBy(key).transformWithStateInPandas(processor, out, "Append", "None")
