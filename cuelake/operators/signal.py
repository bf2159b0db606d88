"""Loudness envelopes: frame levels, the gate of a tape, speech runs and pauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the listener.
FRAME_S, MIN_GAP, PAD, MIN_SHIFT = 0.02, 0.060, 0.030, 0.020
FLOOR_PCT, SPEECH_PCT = 0.10, 0.90
ABOVE_FLOOR_DB, BELOW_SPEECH_DB, HOLD_DB, DYNAMIC_DB, SILENT_DB = 6.0, 12.0, 3.0, 40.0, -46.0


def decibels(x: Column) -> Column:
    return 20.0 * F.log10(F.greatest(x, F.lit(1e-9)))


def histogram(levels: DataFrame, key: str = "tape") -> DataFrame:
    """key, level, n: how many frames of a tape have a level. Histograms of parts of a tape, added up, are that of the tape."""
    return levels.groupBy(key, "level").agg(F.count("*").alias("n"))


def merged(histograms: DataFrame, key: str = "tape") -> DataFrame:
    return histograms.groupBy(key, "level").agg(F.sum("n").alias("n"))


def gates(levels: DataFrame, key: str = "tape") -> DataFrame:
    """key, frames, noise_floor, hi, lo, gate_db, tape_db, silent: each tape's own gate. Ranks are exact, over all of its frames."""
    return gates_of(histogram(levels, key), key)


def gates_of(counts: DataFrame, key: str = "tape") -> DataFrame:
    """The gates of tapes whose histograms are given: the levels at rank round(p * (n - 1)), halves to even."""
    rows = counts.withColumns({"upto": F.sum("n").over(Window.partitionBy(key).orderBy("level")), "frames": F.sum("n").over(Window.partitionBy(key))})
    at = lambda p: F.min(F.when(F.col("upto") > F.rint((F.col("frames") - 1) * F.lit(p)), F.col("level")))
    rows = rows.groupBy(key).agg(F.max("frames").alias("frames"), at(FLOOR_PCT).alias("noise_floor"), at(SPEECH_PCT).alias("top"))
    rows = rows.withColumns({"n_db": decibels(F.col("noise_floor")), "tape_db": decibels(F.col("top"))})
    middle = (F.greatest("n_db", F.col("tape_db") - DYNAMIC_DB) + F.col("tape_db")) / 2.0
    gate = F.least(F.greatest(middle, F.col("n_db") + ABOVE_FLOOR_DB), F.col("tape_db") - BELOW_SPEECH_DB)
    rows = rows.withColumn("gate_db", gate)
    ten = lambda db: F.pow(F.lit(10.0), db / 20.0)
    return rows.select(
        key, "frames", "noise_floor", ten(F.col("gate_db")).alias("hi"), ten(F.col("gate_db") - HOLD_DB).alias("lo"), "gate_db", "tape_db", (F.col("tape_db") < SILENT_DB).alias("silent")
    )


def live_frames(levels: DataFrame, gate: DataFrame, key: str = "tape") -> DataFrame:
    """key, f, level, live: whether a frame lies in speech, which begins at hi and ends under lo; frames between the two keep their state. Silent tapes have no rows."""
    w = Window.partitionBy(key).orderBy("f").rowsBetween(Window.unboundedPreceding, 0)
    rows = levels.join(gate.select(key, "hi", "lo", "silent"), key).filter(~F.col("silent"))
    said = F.when(F.col("level") >= F.col("hi"), True).when(F.col("level") < F.col("lo"), False)
    return rows.select(key, "f", "level", F.coalesce(F.last(said, ignorenulls=True).over(w), F.lit(False)).alias("live"))


def speech_runs(levels: DataFrame, gate: DataFrame, key: str = "tape") -> DataFrame:
    """key, first, last: runs of frames in speech."""
    rows = live_frames(levels, gate, key).select(key, "f", "live").filter("live")
    island = F.col("f") - F.row_number().over(Window.partitionBy(key).orderBy("f"))
    return rows.withColumn("i", island).groupBy(key, "i").agg(F.min("f").alias("first"), F.max("f").alias("last")).drop("i")


def pauses(runs: DataFrame, gate: DataFrame, frame_s: float = FRAME_S, key: str = "tape") -> DataFrame:
    """key, gs, ge: what lies before, between and after the runs, of at least MIN_GAP seconds; silent tapes have none."""
    w = Window.partitionBy(key).orderBy("first")
    tapes = gate.filter(~F.col("silent")).select(key, F.col("frames").alias("first"), F.lit(None).cast("int").alias("last"))
    rows = runs.select(key, F.col("first").cast("long"), "last").unionByName(tapes)
    begin = F.coalesce(F.lag("last").over(w) + 1, F.lit(0))
    ms = lambda f: F.round(f * frame_s, 3)
    gaps = rows.select(key, ms(begin).alias("gs"), ms(F.col("first")).alias("ge"))
    return gaps.filter(F.col("ge") - F.col("gs") >= MIN_GAP)


def frame_levels(samples: Column, frame: int) -> Column:
    """RMS of each whole frame of an array of 16-bit samples, over full scale."""
    n = F.floor(F.size(samples) / frame).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    energy = lambda k: F.aggregate(F.slice(samples, k * frame + 1, frame), F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return F.transform(at, lambda k: F.sqrt(energy(k) / frame) / 32768.0)


def voice_distance(a: Column, b: Column) -> Column:
    """Mean of |x - y| over the greater of the two, in three measures; null where one is missing."""
    parts = F.zip_with(a, b, lambda x, y: F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1e-9)))
    whole = a.isNotNull() & b.isNotNull() & ~F.exists(parts, lambda p: p.isNull())
    return F.when(whole, F.aggregate(parts, F.lit(0.0), lambda s, p: s + p) / F.size(parts))
