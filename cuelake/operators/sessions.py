"""Sessions that slide: a request after the hold of a session begins a new one; a request more than ``step`` after the last renewal renews the hold.

When a session is renewed rests on the renewal before, so that is a fold with two numbers a user. Each request then carries how long it holds, a gap of its
own, and sessions are Spark's session windows with a gap by row. On a stream the same two numbers are a user's state, and a session is
told once its hold lies behind the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .ordered import fold

#: Seconds that a session holds, and after which a request renews it.
HOLD_S, STEP_S = 30 * 24 * 3600, 3600


def _request(renewed: int | None, t: int, hold: int, step: int) -> tuple[int, bool, bool]:
    """(last renewal, whether a new session begins, whether the hold was renewed) after a request; whole seconds."""
    if renewed is None or renewed + hold < t:
        return t, True, True
    return (t, False, True) if t - renewed > step else (renewed, False, False)


def renewals(requests: DataFrame, hold: int = HOLD_S, step: int = STEP_S) -> DataFrame:
    """requests (id, user_id, at: timestamp) with begins, renews and expires (seconds). Requests of one second go by id."""

    def one(state: dict, row: dict) -> tuple:
        state["renewed"], begins, renews = _request(state.get("renewed"), row["t"], hold, step)
        return begins, renews, state["renewed"] + hold

    timed = requests.select("id", "user_id", "at", F.floor(F.unix_micros("at") / 1_000_000).alias("t"))
    return fold(timed, ["user_id"], ["t", "id"], dict, one, "begins boolean, renews boolean, expires long")


def sessions(requests: DataFrame, hold: int = HOLD_S, step: int = STEP_S) -> DataFrame:
    """user_id, first, last, requests, renewals, expires (seconds) of each session."""
    rows = renewals(requests, hold, step)
    # a hold counts to its last second and windows that touch are one, so the gap reaches half a second beyond it
    gap = F.make_interval(secs=(F.col("expires") - F.col("t") + 0.5).cast("decimal(18,6)"))
    per = rows.withColumn("moment", F.timestamp_seconds("t")).groupBy("user_id", F.session_window("moment", gap).alias("w"))
    return per.agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("requests"), F.count_if("renews").alias("renewals"), F.max("expires").alias("expires")).drop("w")


def sessions_stream(requests: DataFrame, late: str, hold: int = HOLD_S, step: int = STEP_S) -> DataFrame:
    """The sessions of a stream of requests that come in order of time (up to ``late``, within which a micro-batch is put in order), each once its hold lies behind the watermark."""

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n, times, renewed = state.get if state.exists else (None, None, 0, 0, None)
        told = []
        if state.hasTimedOut:
            state.remove()
            told.append((key[0], first, last, n, times, renewed + hold))
        else:
            rows = pd.concat(list(chunks)).sort_values(["t", "id"], kind="stable")
            for t in rows["t"].tolist():
                after, begins, renews = _request(renewed, t, hold, step)
                if begins and n:
                    told.append((key[0], first, last, n, times, renewed + hold))
                first, last, n, times, renewed = (t, t, 1, 1, after) if begins else (first, t, n + 1, times + renews, after)
            state.update((first, last, n, times, renewed))
            state.setTimeoutTimestamp(max((renewed + hold + 1) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(told, columns=["user_id", "first", "last", "requests", "renewals", "expires"])

    timed = requests.withWatermark("at", late).select("id", "user_id", "at", F.floor(F.unix_micros("at") / 1_000_000).alias("t"))
    out = "user_id long, first long, last long, requests long, renewals long, expires long"
    return timed.groupBy("user_id").applyInPandasWithState(run, out, "first long, last long, n long, times long, renewed long", "append", GroupStateTimeout.EventTimeTimeout)
