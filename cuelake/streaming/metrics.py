"""Counters of what runs do: observed while rows pass, added up by query, told as lines of text.

``observed`` adds counts to a table or stream that cost no pass of their own. On a table they are there when the action has ended; on a stream a listener
adds up what each micro-batch reports, once a micro-batch.
"""

from __future__ import annotations

import threading
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


def counts(conditions: Mapping[str, Column]) -> list[Column]:
    return [F.count_if(when).alias(name) for name, when in conditions.items()]


def observed(rows: DataFrame, name: str, conditions: Mapping[str, Column]) -> tuple[DataFrame, Observation | None]:
    """(rows that count as they pass, where the counts of a table are found): how many rows fulfil each condition."""
    if rows.isStreaming:
        return rows.observe(name, *counts(conditions)), None
    seen = Observation(name)
    return rows.observe(seen, *counts(conditions)), seen


class Counters(StreamingQueryListener):
    """Sums of observed counts by name of the observation."""

    def __init__(self):
        self.sums: dict[tuple[str, str], int] = {}
        self.lock = threading.Lock()

    def add(self, name: str, found: Mapping[str, int]) -> None:
        with self.lock:
            for key, n in found.items():
                self.sums[name, key] = self.sums.get((name, key), 0) + int(n or 0)

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            self.add(name, row.asDict())

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...


def lines(kind: str, name: str, about: str, values: Mapping[str, object]) -> list[str]:
    """A metric in the text format of collectors: help, type, and a line for each label set (empty for none)."""
    return [f"# HELP {name} {about}", f"# TYPE {name} {kind}", *(f"{name}{labels} {value}" for labels, value in values.items())]
