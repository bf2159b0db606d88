"""A tape that arrives in blocks: levels, gate, voice profiles and what was heard, without the tape ever lying in one task.

Blocks are rows (tape, base: number of the block's first sample, pcm: 16-bit little-endian bytes). What is asked of a tape is a
sum or a window over samples, so each block is reduced where it lies. A frame that two blocks share is the sum of its parts; a profile
window is put together from the few blocks that it touches, which meet by (tape, window) only. The order in which blocks come never matters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cuelake.functions import checks
from cuelake.operators import alignment, signal, words
from cuelake.sources.wav import SAMPLES_LEAST

#: Every how many-th sample a profile takes, samples that it needs, samples of a block bucket.
STRIDE, PROFILE_LEAST = 2, 32
BUCKET = 60 * checks.PCM_RATE


def whole_samples(chunks: DataFrame) -> DataFrame:
    """Blocks from chunks of bytes (tape, at: offset of the first byte, bytes) cut anywhere: a sample whose two bytes lie in two chunks goes to the first."""
    odd = F.pmod(F.col("at"), F.lit(2)) == 1
    head = F.when(odd, F.substring("bytes", 1, 1))
    body = F.when(odd, F.expr("substring(bytes, 2)")).otherwise(F.col("bytes"))
    parts = chunks.select("tape", F.when(odd, F.col("at") - 1).alias("before"), head.alias("head"), F.when(odd, F.col("at") + 1).otherwise(F.col("at")).alias("at"), body.alias("body"))
    ends = parts.filter("head IS NOT NULL").select(F.col("tape").alias("_tape"), F.col("before").alias("_at"), "head")
    half = F.pmod(F.octet_length("body"), F.lit(2)) == 1
    last = F.when(half, F.col("at") + F.octet_length("body") - 1)
    joined = parts.drop("head", "before").withColumn("last", last).join(ends, (F.col("tape") == F.col("_tape")) & (F.col("last") == F.col("_at")), "left")
    whole = F.when(half & F.col("head").isNotNull(), F.concat("body", "head")).when(half, F.expr("substring(body, 1, octet_length(body) - 1)")).otherwise(F.col("body"))
    return joined.select("tape", F.floor(F.col("at") / 2).alias("base"), whole.alias("pcm")).filter(F.octet_length("pcm") > 0)


def paid_for(blocks: DataFrame, tapes: DataFrame) -> DataFrame:
    """Blocks as far as their tape is listened to: paid minutes and slack, at most a job's limit. tapes: tape, minutes."""
    stop = tapes.select("tape", (checks.listening(F.col("minutes")).getField("want") * checks.PCM_RATE).cast("long").alias("_stop"))
    rows = blocks.join(stop, "tape").filter(F.col("base") < F.col("_stop"))
    return rows.select("tape", "base", F.expr("substring(pcm, 1, CAST(least(octet_length(pcm), 2 * (_stop - base)) AS INT))").alias("pcm"))


def heard(blocks: DataFrame, tapes: DataFrame) -> DataFrame:
    """tape, heard_s, paid_s, reach_s, code, cut_short: what the pass over a tape reports; a tape without samples has no row."""
    read = paid_for(blocks, tapes).groupBy("tape").agg(F.sum(F.floor(F.octet_length("pcm") / 2)).alias("n")).filter("n > 0")
    rows = read.join(tapes.select("tape", checks.listening(F.col("minutes")).alias("l")), "tape")
    s = F.col("n") / checks.PCM_RATE
    return rows.select(
        "tape", F.round(s, 3).alias("heard_s"), F.round("l.paid", 3).alias("paid_s"), F.round("l.want", 3).alias("reach_s"),
        F.when(F.col("n") < SAMPLES_LEAST, "too_short").alias("code"), checks.cut_short(s, F.col("l.want"), F.col("l.paid")).alias("cut_short"),
    )


def level_parts(blocks: DataFrame, frame: int) -> DataFrame:
    """tape, f, energy, n: what each block adds to the energy of a frame, and with how many samples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for tape, base, pcm in zip(pdf["tape"], pdf["base"], pdf["pcm"], strict=True):
                x = np.frombuffer(pcm[: len(pcm) // 2 * 2], dtype="<i2").astype(np.int64)
                f = (base + np.arange(len(x))) // frame
                first = np.flatnonzero(np.diff(f, prepend=-1))
                if len(x):
                    parts.append(pd.DataFrame({"tape": tape, "f": f[first], "energy": np.add.reduceat(x * x, first), "n": np.diff(np.append(first, len(x)))}))
            yield pd.concat(parts) if parts else pd.DataFrame({"tape": [], "f": [], "energy": [], "n": []}).astype("int64")

    return blocks.select("tape", "base", "pcm").mapInPandas(run, "tape long, f long, energy long, n long")


def summed(parts: DataFrame) -> DataFrame:
    """The same with one row for each frame."""
    return parts.groupBy("tape", "f").agg(F.sum("energy").alias("energy"), F.sum("n").alias("n"))


def levels_of(parts: DataFrame, frame: int) -> DataFrame:
    """tape, f, level of the frames that are whole."""
    whole = summed(parts).filter(F.col("n") == frame)
    return whole.select("tape", F.col("f").cast("int").alias("f"), (F.sqrt(F.col("energy") / frame) / 32768.0).alias("level"))


def levels(blocks: DataFrame, frame: int) -> DataFrame:
    """tape, f, level: RMS of the tape's whole frames over full scale. Energies are whole numbers, so the cutting into blocks never shows."""
    return levels_of(level_parts(blocks, frame), frame)


def collecting(blocks: DataFrame, frame: int, folder: str, checkpoint: str) -> StreamingQuery:
    """A query that takes in the blocks of a stream that are there, and then ends: each micro-batch's energies are one folder of Parquet.

    A micro-batch that is run again replaces its folder, so nothing counts twice. No state is kept: a frame that blocks of several micro-batches share
    is summed when the parts are read, and a tape can be asked for its curve, cues or words whenever it has ended.
    """

    none = blocks.sparkSession.createDataFrame([], "tape long, f long, energy long, n long")
    none.write.mode("overwrite").parquet(f"{folder}/batch=none")

    def keep(rows: DataFrame, batch: int) -> None:
        summed(level_parts(rows, frame)).write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return blocks.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collected(spark: SparkSession, folder: str, frame: int) -> DataFrame:
    """The levels of the tapes that ``collecting`` took in."""
    return levels_of(spark.read.schema("tape long, f long, energy long, n long").option("recursiveFileLookup", "true").parquet(folder), frame)


def curve(found: DataFrame, frame: int) -> DataFrame:
    """tape, frames, seconds, noise_floor, gate_db, tape_db, silent, speech_s, pauses: what a tape's curve says once it has ended; found: levels."""
    frame_s, gate = frame / checks.PCM_RATE, signal.gates(found)
    runs = signal.speech_runs(found, gate)
    said = runs.groupBy("tape").agg((F.sum(F.col("last") - F.col("first") + 1) * F.lit(frame_s)).alias("speech_s"))
    quiet = signal.pauses(runs, gate, frame_s).groupBy("tape").agg(F.count("*").alias("pauses"))
    rows = gate.join(said, "tape", "left").join(quiet, "tape", "left")
    return rows.select(
        "tape", "frames", (F.col("frames") * F.lit(frame_s)).alias("seconds"), "noise_floor", "gate_db", "tape_db", "silent",
        F.coalesce("speech_s", F.lit(0.0)).alias("speech_s"), F.coalesce("pauses", F.lit(0)).alias("pauses"),
    )


def voice(samples: np.ndarray) -> tuple[float, float, float] | None:
    """(loudness, share of sign changes, brightness: root of the steps' energy over the samples'); None for few samples or silence."""
    x = samples.astype(np.int64)
    if len(x) < PROFILE_LEAST or not x.any():
        return None
    energy = int((x * x).sum()) / len(x)
    steps = np.diff(x)
    turns = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return round(energy**0.5 / 32768.0, 4), round(turns / len(steps), 4), round((int((steps * steps).sum()) / len(steps) / energy) ** 0.5, 4)


def window_profiles(blocks: DataFrame, windows: DataFrame) -> DataFrame:
    """tape, idx, k, whole, voice: the profile of each window of samples [a, b); not whole where the tape lacks some of them.

    windows: tape, idx, k, a, b. Windows and blocks meet on (tape, stretch of BUCKET samples), and only the bytes a window covers travel on.
    """
    n = F.floor(F.octet_length("pcm") / 2)
    stretch = lambda a, b: F.explode(F.sequence(F.floor(a / BUCKET), F.floor((b - 1) / BUCKET)))
    have = blocks.filter(n > 0).withColumn("end", F.col("base") + n).withColumn("_s", stretch(F.col("base"), F.col("base") + n))
    want = windows.filter("b > a").withColumn("_s", stretch(F.col("a"), F.col("b")))
    lo, hi = F.greatest("a", "base"), F.least("b", "end")
    # a pair counts in the stretch where what they share begins
    met = want.join(have, ["tape", "_s"]).filter((hi > lo) & (F.floor(lo / BUCKET) == F.col("_s")))
    part = F.expr("substring(pcm, CAST(2 * (greatest(a, base) - base) + 1 AS INT), CAST(2 * (least(b, end) - greatest(a, base)) AS INT))")
    parts = met.select("tape", "idx", "k", "a", "b", lo.alias("at"), part.alias("pcm"))
    joined = parts.groupBy("tape", "idx", "k", "a", "b").agg(F.array_sort(F.collect_list(F.struct("at", "pcm"))).alias("parts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                pcm = b"".join(p["pcm"] for p in row.parts)
                whole = len(pcm) == 2 * (row.b - row.a)
                found = voice(np.frombuffer(pcm, dtype="<i2")[::STRIDE]) if whole else None
                out.append((row.tape, row.idx, row.k, whole, None if found is None else list(found)))
            yield pd.DataFrame(out, columns=["tape", "idx", "k", "whole", "voice"])

    return joined.mapInPandas(run, "tape long, idx long, k int, whole boolean, voice array<double>")


def voices(blocks: DataFrame, windows: DataFrame) -> DataFrame:
    """tape, idx, voice: the mean of a cue's profiles, to four places; null where a window is missing or cut off, or none gives a profile."""
    found = window_profiles(blocks, windows)
    rows = windows.select("tape", F.col("idx").cast("long").alias("idx"), "k").join(found, ["tape", "idx", "k"], "left")
    mean = F.array(*[F.bround(F.avg(F.get("voice", F.lit(j))), 4) for j in range(3)])
    per = rows.groupBy("tape", "idx").agg(F.bool_and(F.coalesce("whole", F.lit(False))).alias("whole"), F.count("voice").alias("n"), mean.alias("voice"))
    return per.select("tape", "idx", F.when(F.col("whole") & (F.col("n") > 0), F.col("voice")).alias("voice"))


def lost(profiles: DataFrame) -> DataFrame:
    """tape, cues, lost: how many cues of a tape got no voice."""
    return profiles.groupBy("tape").agg(F.count("*").alias("cues"), F.count_if(F.col("voice").isNull()).alias("lost"))


def aligned_levels(found: DataFrame, cues: DataFrame, frame: int) -> DataFrame:
    """Cues of tapes moved into their pauses. found: levels, of a table of blocks or collected from a stream; cues: tape, idx, s, e."""
    frame_s, gate = frame / checks.PCM_RATE, signal.gates(found)
    return alignment.aligned(cues, signal.pauses(signal.speech_runs(found, gate), gate, frame_s), gate, frame_s)


def words_levels(found: DataFrame, cues: DataFrame, frame: int) -> DataFrame:
    """Word times of tapes' cues. found: levels, as above; cues: tape, idx, s, e, text."""
    return words.words_timed(cues, found, signal.gates(found), frame / checks.PCM_RATE)


def aligned_blocks(blocks: DataFrame, cues: DataFrame, frame: int) -> DataFrame:
    """As ``aligned_levels``. The levels, a small part of the samples, are persisted, as they are asked for several times; Spark's cache lets them go."""
    return aligned_levels(levels(blocks, frame).persist(), cues, frame)


def words_blocks(blocks: DataFrame, cues: DataFrame, frame: int) -> DataFrame:
    """As ``words_levels``, with persisted levels."""
    return words_levels(levels(blocks, frame).persist(), cues, frame)
