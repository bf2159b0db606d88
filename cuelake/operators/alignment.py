"""Cue boundaries moved into the pauses of a tape.

Cues go left to right: how far a boundary may move depends on where the one before it ended up, so a tape's cues pass one task in order. Each
brings the pauses near it; per boundary those that can answer are found by binary search.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import intervals
from .ordered import fold
from .signal import MIN_SHIFT, PAD

#: How far a boundary may move, least dwell, least distance of cards, most dwell that may be lost.
REACH, REACH_MOST, REACH_LEAST = 0.60, 2.00, 0.050
MIN_SPAN, MIN_SEP, MOST_LOSS = 0.200, 0.020, 0.40
_EPS = 1e-9
#: Seconds of a stretch in which cues meet pauses.
STRETCH_S = 10.0


class Pauses:
    """Stretches in which a cut may sit: pauses, in order, less PAD at both ends."""

    def __init__(self, gaps: list[tuple[float, float]]):
        self.a = np.array([s + PAD for s, _ in gaps])
        self.b = np.array([e - PAD for _, e in gaps])

    def at(self, t: float) -> int:
        """The stretch that holds a moment, or -1."""
        k = int(np.searchsorted(self.a, t, side="right")) - 1
        return k if k >= 0 and self.a[k] < self.b[k] and t <= self.b[k] else -1

    def swallow(self, start: float, end: float) -> bool:
        """Whether one stretch holds a whole card."""
        k = self.at(start)
        return k >= 0 and end <= self.b[k]

    def nearest(self, t: float, low: float, high: float) -> float | None:
        """The moment within [low, high] in a stretch that is nearest, at least MIN_SHIFT away; the earlier on ties."""
        if high < low:
            return None
        k = np.arange(np.searchsorted(self.b, low), np.searchsorted(self.a, high, side="right"))
        k = k[self.a[k] < self.b[k]]
        to = np.clip(t, np.maximum(self.a[k], low), np.minimum(self.b[k], high))
        far = np.abs(to - t)
        ok = far >= MIN_SHIFT
        if not ok.any():
            return None
        near = to[ok][far[ok] <= far[ok].min() + _EPS]
        return float(near.min())


@dataclass
class Moved:
    """A tape's answer: cues with their new times, and the tally."""

    spans: list[tuple[float, float]]
    moves: list[tuple[int, str, float, float]]
    in_silence: int = 0
    already: int = 0


@dataclass
class Cut:
    """Where a cue's boundaries end up; a new one is None where its boundary stays or a move is undone."""

    s: float
    e: float
    new_start: float | None
    new_end: float | None


def cut(quiet: Pauses, start: float, end: float, following: tuple[float, float] | None, edge: float, duration: float, reach: float) -> Cut:
    """One cue's boundaries, each moved to the nearest pause that its neighbours leave open; ``edge`` is where the card before ends now.

    Where a cue ends as the next begins, the cut is one and moves as one. A move is undone if it would put a whole card into one
    pause, or take more than MOST_LOSS of its dwell.
    """
    keep = (end - start) * (1 - MOST_LOSS)
    new_start = quiet.nearest(start, max(start - reach, edge), min(start + reach, end - MIN_SPAN))
    s = start if new_start is None else new_start
    low, high = s + MIN_SPAN, following[0] if following else duration
    if following and abs(following[0] - end) <= 1e-6:
        low = max(low, s + keep)
        high = min(following[1] - MIN_SPAN, end + (following[1] - end) * MOST_LOSS)
    new_end = quiet.nearest(end, max(end - reach, low), min(end + reach, high))
    out = Cut(s, end if new_end is None else new_end, new_start, new_end)

    def undo(first: bool, second: bool) -> None:
        if second:
            out.e, out.new_end = end, None
        if first:  # the old start, or as near to it as the card before allows
            out.s, out.new_start = max(start, min(edge, out.e - MIN_SEP)), None

    swallowed = lambda a, b: quiet.swallow(a, b)
    if swallowed(out.s, out.e) and not swallowed(start, end):
        if new_start is not None and not swallowed(out.s, end):
            undo(False, True)
        elif new_end is not None and not swallowed(start, out.e):
            undo(True, False)
        else:
            undo(True, True)
    if out.e - out.s < keep:
        if end - out.s >= keep:
            undo(False, True)
        elif out.e - start >= keep:
            undo(True, False)
        else:
            undo(True, True)
    return out


def align(cues: list[tuple[float, float]], gaps: list[tuple[float, float]], duration: float, reach: float = REACH) -> Moved:
    """Boundaries (start, end) of cues in order, with all pauses of the tape."""
    if not REACH_LEAST <= reach <= REACH_MOST:
        raise ValueError(f"reach must lie between {REACH_LEAST} and {REACH_MOST} seconds")
    quiet, out, edge = Pauses(gaps), Moved([], []), 0.0
    for i, (start, end) in enumerate(cues):
        c = cut(quiet, start, end, cues[i + 1] if i + 1 < len(cues) else None, edge, duration, reach)
        for name, old, now, moved in (("start", start, c.s, c.new_start), ("end", end, c.e, c.new_end)):
            silent = quiet.at(old) >= 0
            out.already += silent
            out.in_silence += moved is not None or (silent and now == old)
            if moved is not None:
                out.moves.append((i, name, old, now))
        edge = c.e
        out.spans.append((round(c.s, 3), round(c.e, 3)))
    return out


def aligned(cues: DataFrame, pauses: DataFrame, gates: DataFrame, frame_s: float, reach: float = REACH) -> DataFrame:
    """tape, idx, start, end, moved (0 to 2). cues: tape, idx, s, e; pauses and gates as in ``signal``. Tapes without pauses keep their cues.

    A cue meets the pauses within reach of its boundaries, by stretches of time, so a row holds those and never a tape's; cues then pass in order,
    and what is held of a tape is where the card before ends.
    """
    if not REACH_LEAST <= reach <= REACH_MOST:
        raise ValueError(f"reach must lie between {REACH_LEAST} and {REACH_MOST} seconds")
    following = F.lead(F.struct("s", "e")).over(Window.partitionBy("tape").orderBy("idx"))
    rows = cues.select("tape", "idx", "s", "e").withColumn("following", following)
    rows = rows.join(gates.select("tape", (F.col("frames") * F.lit(frame_s)).alias("duration")), "tape")
    far = F.lit(reach + 1.0)
    near = rows.select("tape", "idx", (F.col("s") - far).alias("s"), (F.greatest("s", "e") + far).alias("e"))
    meets = intervals.overlaps(near, pauses.select("tape", "gs", "ge", F.col("gs").alias("rs"), F.col("ge").alias("re")), "tape", STRETCH_S)
    quiet = meets.groupBy("tape", "idx").agg(F.array_sort(F.collect_set(F.struct("gs", "ge"))).alias("quiet"))
    rows = rows.join(quiet, ["tape", "idx"], "left")

    def step(state: dict, row: dict) -> tuple:
        gaps = Pauses([(q["gs"], q["ge"]) for q in row["quiet"] or []])
        after = row["following"]
        c = cut(gaps, row["s"], row["e"], (after["s"], after["e"]) if after else None, state.get("edge", 0.0), row["duration"], reach)
        state["edge"] = c.e
        return round(c.s, 3), round(c.e, 3), int(c.new_start is not None) + int(c.new_end is not None)

    return fold(rows, ["tape"], ["idx"], dict, step, "start double, end double, moved int").select("tape", "idx", "start", "end", "moved")
