"""Sliding-window admission of a stream of hits."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import constants as K
from ..operators.events import admit


def _decide(max_hits: int, window_us: int):
    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = deque(state.get[0] if state.exists else [], maxlen=max_hits)
        # One key's hits of one micro-batch, as two narrow columns.
        hits = pd.concat(list(batches)).sort_values(["us", "id"])
        accepted = admit(hits["us"].to_numpy(), recent, window_us, max_hits)
        if recent:
            state.update((list(recent),))
            forget_ms = (recent[-1] + window_us) // 1000 + 1
            state.setTimeoutTimestamp(max(forget_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "id": hits["id"], "accepted": accepted})

    return run


def rate_limit_stream(hits: DataFrame, key: str, ts: str, event_id: str, max_hits: int = K.RATE_MAX_HITS,
                      window_seconds: int = K.RATE_WINDOW_SECONDS, lateness: str = "10 minutes") -> DataFrame:
    """(key, id, accepted) for a stream; ``ts`` must be a timestamp column.

    The state of a key is its last ``max_hits`` accepted times, dropped once
    the watermark has passed the last of them by the window.  Hits within a
    micro-batch are taken in time order; hits later than the watermark are
    dropped.
    """
    marked = hits.withWatermark(ts, lateness)
    narrow = marked.select(F.col(key).alias("key"), F.col(event_id).alias("id"), F.col(ts).alias("ts"),
                           F.unix_micros(F.col(ts)).alias("us"))
    types = dict(narrow.dtypes)
    return narrow.groupBy("key").applyInPandasWithState(
        _decide(max_hits, window_seconds * 1_000_000),
        outputStructType=f"key {types['key']}, id {types['id']}, accepted boolean",
        stateStructType="recent array<bigint>", outputMode="append", timeoutConf=GroupStateTimeout.EventTimeTimeout)
