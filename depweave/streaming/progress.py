"""Incremental forms of the status reports over a stream of events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, *, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n) per tumbling window; events later than ``late`` behind the newest are left out."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("start"), "event_type", "n")
    )


def latest_results(events: DataFrame) -> DataFrame:
    """(gwt_id, result) after each micro-batch: the newest event of each user, kept as state of one row per user."""
    newest = F.max_by("event_type", F.struct("ts", "event_id"))
    return events.groupBy(F.concat(F.lit("gwt-"), F.col("user_id").cast("string")).alias("gwt_id")).agg(newest.alias("result"))


_STATE = "attempt bigint, phase string, state string"


def _followed(quiet_ms: int) -> Callable:
    """State of one entry: its newest attempt and phase; a timer that no update has put off makes it stale."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempt, phase, now = state.get if state.exists else (0, "unknown", "running")
        if state.hasTimedOut:
            now = "stale"
        else:
            rows = pd.concat(list(batches)).sort_values(["attempt", "updated_at"], kind="stable")
            last = rows.iloc[-1]
            attempt, phase = max(int(last["attempt"]), attempt), str(last["phase"])
            now = "done" if now == "done" or bool(rows["finished"].any()) else "running"
        state.update((attempt, phase, now))
        if now == "running":
            state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame({"gwt_id": [key[0]], "attempt": [attempt], "phase": [phase], "state": [now]})

    return run


def live_states(updates: DataFrame, *, quiet: int = 60) -> DataFrame:
    """(gwt_id, attempt, phase, state) whenever an entry changes: running on an update (gwt_id, attempt, phase, updated_at, finished), done once one is finished, stale after ``quiet`` seconds without any.

    A stale entry runs again with its next update; a done one stays done.  The state is one row per entry.
    """
    return updates.groupBy("gwt_id").applyInPandasWithState(
        _followed(quiet * 1000), "gwt_id string, " + _STATE, _STATE, "update", GroupStateTimeout.ProcessingTimeTimeout
    )
