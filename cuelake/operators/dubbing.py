"""A dubbed tape from voices: where they go, what was moved, and the sum of their samples in blocks.

Voices meet blocks of the tape, not the tape: each is cut where blocks begin, and a block sums its pieces in the order of their lines, clipped at
full scale after each. A tape of any length is many short rows in many tasks, and a task holds one block and one piece.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import intervals

#: Rate of a dub, slack beyond twice the lines' end, most seconds, the stand-in's bounds, loudness, pitch and sway.
RATE, SLACK_S, MOST_S = 22050, 60.0, 900.0
TONE_LEAST, TONE_MOST, LOUD, PITCH, PITCH_OTHER, SWAY, SWAY_HZ = 0.3, 30.0, 12000, 220.0, 180.0, 40, 1.7
BLOCK = 22050
MIXED = "tape long, block long, base long, pcm binary"


def scheduled(lines: DataFrame, key: str = "tape", order: str = "line", start: str = "s", end: str = "e", length: str = "len") -> DataFrame:
    """lines with placed (no line begins before the one ahead has ended), total and clipped: the tape's length and whether a tail lies beyond what it may have."""
    rows = intervals.packed_starts(lines, key, order, start, length)
    ends = rows.groupBy(F.col(key).alias("_k")).agg(F.max(F.col("placed") + F.greatest(length, F.lit(0.0))).alias("_head"), F.max(end).alias("_end"))
    wanted, most = F.greatest("_head", "_end", F.lit(1.0)), F.least(F.col("_end") * 2.0 + SLACK_S, F.lit(MOST_S))
    ends = ends.select("_k", F.least(wanted, most).alias("total"), (wanted > most).alias("clipped"))
    return rows.join(ends, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")


def report(placed: DataFrame, key: str = "tape", start: str = "s", end: str = "e", length: str = "len") -> DataFrame:
    """key, lines, shifted, clipped, drift_sec, total_sec of lines that ``scheduled`` gives."""
    drift = F.max(F.col("placed") + F.col(length) - F.col(end))
    return placed.groupBy(key).agg(
        F.count("*").alias("lines"), F.count_if(F.col("placed") > F.col(start) + 1e-6).alias("shifted"), F.bool_or("clipped").alias("clipped"),
        F.round(drift, 3).alias("drift_sec"), F.round(F.max("total"), 3).alias("total_sec"),
    )


def mixed(voices: DataFrame, totals: DataFrame, block: int = BLOCK) -> DataFrame:
    """MIXED: each tape's samples in blocks, silence included. voices: tape, line, at (first sample), pcm (16 bits); totals: tape, samples."""
    n = F.floor(F.octet_length("pcm") / 2)
    ends = voices.join(totals, "tape").withColumn("to", F.least(F.col("at") + n, F.col("samples"))).filter(F.col("to") > F.col("at"))
    cut = F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("to") - 1) / block)))
    a, b = F.greatest("at", F.col("block") * block), F.least("to", (F.col("block") + 1) * block)
    part = F.substring("pcm", (2 * (a - F.col("at")) + 1).cast("int"), (2 * (b - a)).cast("int"))
    pieces = ends.withColumn("block", cut).select("tape", "block", "line", (a - F.col("block") * block).alias("off"), part.alias("pcm"), F.lit(None).cast("long").alias("size"))
    blank = totals.filter("samples > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("samples") - 1) / block))))
    size = F.least(F.lit(block).cast("long"), F.col("samples") - F.col("block") * block)
    blank = blank.select("tape", "block", F.lit(None).cast("long").alias("line"), F.lit(0).cast("long").alias("off"), F.lit(None).cast("binary").alias("pcm"), size.alias("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(at: tuple, held: np.ndarray) -> pa.RecordBatch:
            cols = (at[0], at[1], at[1] * block, held.astype("<i2").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["tape", "block", "base", "pcm"])

        at, held = None, np.zeros(0, dtype=np.int32)
        for batch in batches:
            for tape, k, _, off, pcm, size in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if pcm is None:  # the blank of a block comes first
                    if at is not None:
                        yield out(at, held)
                    at, held = (tape, k), np.zeros(size, dtype=np.int32)
                else:
                    part = held[off : off + len(pcm) // 2]
                    np.clip(part + np.frombuffer(pcm, dtype="<i2")[: len(part)], -32768, 32767, out=part)
        if at is not None:
            yield out(at, held)

    rows = pieces.unionByName(blank).repartition("tape", "block").sortWithinPartitions("tape", "block", "line", "off", "pcm")
    return rows.select("tape", "block", "line", "off", "pcm", "size").mapInArrow(run, MIXED)


def tone(seconds: Column, lang: Column, rate: int = RATE) -> Column:
    """The stand-in for a voice: an array of samples of a swaying tone that swells and fades."""
    dur = F.greatest(F.lit(TONE_LEAST), F.least(seconds, F.lit(TONE_MOST)))
    base = F.when(lang == "uz", PITCH).otherwise(PITCH_OTHER)

    def sample(i: Column) -> Column:
        t = i / F.lit(float(rate))
        swell = F.sin(F.lit(math.pi) * F.least(F.lit(1.0), t / dur))
        pitch = base + SWAY * F.sin(F.lit(2 * math.pi * SWAY_HZ) * t)
        return (LOUD * swell * F.sin(F.lit(2 * math.pi) * pitch * t)).cast("int")

    return F.transform(F.sequence(F.lit(0), F.floor(F.lit(rate) * dur).cast("int") - 1), sample)


def tone_files(rows: DataFrame, seconds: Column, lang: Column, rate: int = RATE) -> DataFrame:
    """rows with samples (their number) and wav (the stand-in's WAV file, as ``wav(tone(...))`` makes it), row by row on Arrow batches."""
    at = len(rows.columns)
    asked = rows.withColumns({"samples": F.greatest(F.lit(TONE_LEAST), F.least(seconds, F.lit(TONE_MOST))), "wav": F.when(lang == "uz", PITCH).otherwise(PITCH_OTHER)})

    def one(dur: float, base: float) -> bytes:
        n = math.floor(rate * dur)
        t = np.arange(n) / float(rate)
        swell = np.sin(math.pi * np.minimum(1.0, t / dur))
        pitch = base + SWAY * np.sin((2 * math.pi * SWAY_HZ) * t)
        x = np.trunc(LOUD * swell * np.sin((2 * math.pi) * pitch * t)).astype("<i2").tobytes()
        return b"RIFF" + struct.pack("<I4s4sIHHIIHH4sI", len(x) + 36, b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(x)) + x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                files = [one(d, b) for d, b in zip(part.column(at).to_pylist(), part.column(at + 1).to_pylist(), strict=True)]
                cols = [*part.columns[:at], pa.array([(len(f) - 44) // 2 for f in files], pa.int64()), pa.array(files, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)

    schema = T.StructType([*rows.schema.fields, T.StructField("samples", T.LongType()), T.StructField("wav", T.BinaryType())])
    return asked.mapInArrow(run, schema)


def _little(n: Column, size: int) -> Column:
    """A whole number's bytes, the least first, as hexadecimal digits."""
    digits = F.lpad(F.hex(F.pmod(n.cast("long"), F.lit(1 << (8 * size)))), 2 * size, "0")
    return F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])


def wav(samples: Column, rate: int = RATE) -> Column:
    """A WAV file (16 bits, one channel) of an array of samples, as a binary made in the row."""
    n = F.size(samples) * 2
    head = [F.lit("52494646"), _little(n + 36, 4), F.lit("57415645666D74201000000001000100"), _little(F.lit(rate), 4), _little(F.lit(2 * rate), 4), F.lit("0200100064617461"), _little(n, 4)]
    return F.unhex(F.concat(*head, F.array_join(F.transform(samples, lambda x: _little(x, 2)), "")))
