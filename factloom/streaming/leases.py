"""Processing leases as a stream: heartbeats extend a lease, a late one takes it over with a higher fence."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "user_id long, fence long, last_beat_us long, beats long"
STATE = "fence long, last_beat_us long, beats long"


def _advance(lease_us: int):
    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fence, last, beats = state.get if state.exists else (0, None, 0)
        for frame in frames:
            for at in sorted(frame["us"]):
                if last is None or at - last > lease_us:
                    fence, beats = fence + 1, 0
                last, beats = (at if last is None else max(last, at)), beats + 1
        state.update((fence, last, beats))
        yield pd.DataFrame({"user_id": [key[0]], "fence": [fence], "last_beat_us": [last], "beats": [beats]})

    return advance


def lease_states(beats: DataFrame, lease_ms: int) -> DataFrame:
    """The current lease of each key after every batch: fence, last beat and beats under it."""
    timed = beats.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return timed.groupBy("user_id").applyInPandasWithState(_advance(lease_ms * 1000), OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def run_available(beats: DataFrame, lease_ms: int, name: str, checkpoint: str) -> Any:
    """Processes what is there now into an in-memory table and stops."""
    query = lease_states(beats, lease_ms).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
