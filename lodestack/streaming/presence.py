"""Heartbeats and lock requests as streams; an addition to the batch operators of the same names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def distinct_heartbeats(beats: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Heartbeats without those that the sender repeated within the watermark ``delay`` of ``ts``."""
    return beats.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "session_id", "event_id"])


def session_windows(beats: DataFrame, gap: str = "5 minutes", delay: str = "1 minute") -> DataFrame:
    """(user_id, session_id, window, n, last): runs of heartbeats with no pause of ``gap`` or more."""
    own = F.session_window("ts", gap)
    return beats.withWatermark("ts", delay).groupBy("user_id", "session_id", own.alias("window")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))


def lock_outcomes(requests: DataFrame) -> DataFrame:
    """(lock_key, event_id, user_id, outcome) for a stream of lock requests, with the holder as keyed state.

    Requests of one batch are taken in order of (ts, event_id). A key's state is
    one user id, or nothing while the lock is free.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        holder = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        outcomes = []
        for action, user in zip(rows.action, rows.user_id):
            other = holder is not None and holder != user
            if action == "acquire":
                outcomes.append("held_by_other" if other else "acquired")
                holder = holder if other else user
            else:
                outcomes.append("not_found" if holder is None else "not_owner" if other else "released")
                holder = holder if other else None
        if holder is None:
            if state.exists:
                state.remove()
        else:
            state.update((int(holder),))
        yield pd.DataFrame({"lock_key": key[0], "event_id": rows.event_id.to_numpy(), "user_id": rows.user_id.to_numpy(), "outcome": outcomes})

    return requests.groupBy("lock_key").applyInPandasWithState(run, "lock_key string, event_id long, user_id long, outcome string", "holder long", "append", GroupStateTimeout.NoTimeout)
