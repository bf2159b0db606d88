"""Mixed blocks against a sum over the whole tape, schedules' reports, tones read back."""

from __future__ import annotations

import io
import math
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.operators import dubbing as D
from cuelake.sources.wav import read_wav


def whole(lines, samples):
    out = [0] * samples
    for at, x in lines:
        for k, v in enumerate(x):
            if 0 <= at + k < samples:
                out[at + k] = max(-32768, min(32767, out[at + k] + v))
    return np.array(out, dtype="<i2")


@pytest.mark.parametrize("block", [7, 1000, 1 << 20])
def test_blocks_are_the_whole_tape(spark, block):
    rng = random.Random(4)
    tapes = {k: [(rng.randint(0, 900), [rng.randint(-32768, 32767) for _ in range(rng.choice([0, 1, 40, 700]))]) for _ in range(9)] for k in (1, 2)}
    tapes[3] = [(0, [20000] * 50), (0, [20000] * 50), (0, [-20000] * 50), (49, [1])]  # the order of lines shows where it clips
    sizes = {1: 1200, 2: 900, 3: 60, 4: 33}
    rows = [(k, i, at, np.array(x, dtype="<i2").tobytes()) for k, v in tapes.items() for i, (at, x) in enumerate(v)]
    rng.shuffle(rows)
    voices = spark.createDataFrame(rows, "tape long, line long, at long, pcm binary").repartition(5)
    totals = spark.createDataFrame(list(sizes.items()), "tape long, samples long")
    got = {}
    for r in sorted(D.mixed(voices, totals, block).collect()):
        assert r.base == r.block * block
        got.setdefault(r.tape, []).append(bytes(r.pcm))
    assert set(got) == {1, 2, 3, 4}
    for k, n in sizes.items():
        assert all(len(p) == 2 * block for p in got[k][:-1])
        assert b"".join(got[k]) == whole(tapes.get(k, []), n).tobytes()
    assert D.mixed(voices.limit(0), totals.limit(0), block).count() == 0


def test_schedule_and_report(spark):
    rows = [(1, 0, 0.0, 2.0, 3.0), (1, 1, 2.0, 4.0, 1.0), (1, 2, 9.0, 10.0, 0.5), (2, 0, 0.0, 0.2, 0.1), (3, 0, 0.0, 10.0, 100.0), (4, 0, 5.0, 6.0, 0.0)]
    placed = D.scheduled(spark.createDataFrame(rows, "tape long, line long, s double, e double, len double"))
    assert [(r.tape, r.placed) for r in sorted(placed.collect())] == [(1, 0.0), (1, 3.0), (1, 9.0), (2, 0.0), (3, 0.0), (4, 5.0)]
    got = {r.tape: tuple(r)[1:] for r in D.report(placed).collect()}
    assert got == {1: (3, 1, False, 1.0, 10.0), 2: (1, 0, False, -0.1, 1.0), 3: (1, 0, True, 90.0, 80.0), 4: (1, 0, False, -1.0, 6.0)}


def test_tones_are_wav_files(spark):
    rows = spark.createDataFrame([(0.01, "uz"), (0.5, None), (99.0, "ru")], "s double, lang string")
    rate = 800
    got = rows.select("s", "lang", D.tone(F.col("s"), F.col("lang"), rate).alias("x")).withColumn("w", D.wav(F.col("x"), 8000)).collect()
    for r in got:
        dur = min(30.0, max(0.3, r.s))
        assert len(r.x) == int(rate * dur)
        for i in range(0, len(r.x), 37):
            t = i / rate
            f = (220.0 if r.lang == "uz" else 180.0) + 40 * math.sin(2 * math.pi * 1.7 * t)
            assert r.x[i] == pytest.approx(12000 * math.sin(math.pi * min(1.0, t / dur)) * math.sin(2 * math.pi * f * t), abs=1)
        with wave.open(io.BytesIO(bytes(r.w))) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.getnframes()) == (1, 2, 8000, len(r.x))
        assert read_wav(bytes(r.w))[0].tolist() == r.x


def test_wav_of_any_samples(spark):
    x = [0, 1, -1, 32767, -32768, 256, -256]
    [r] = spark.createDataFrame([(x,)], "x array<int>").select(D.wav(F.col("x"), 44100).alias("w")).collect()
    got, rate = read_wav(bytes(r.w))
    assert got.tolist() == x and rate == 44100


def test_tone_files_are_the_files_of_tones(spark):
    from pyspark.sql import functions as F

    from cuelake.operators import dubbing as D

    rows = spark.createDataFrame([(k, s, lang) for k, (s, lang) in enumerate([(0.1, "uz"), (0.375, "ru"), (0.51, "uz"), (1.0, "ru")])], "k int, s double, lang string")
    made = D.tone_files(rows, F.col("s"), F.col("lang"), 8000).select("k", "samples", F.md5("wav").alias("m")).collect()
    want = rows.select("k", D.tone(F.col("s"), F.col("lang"), 8000).alias("x")).select("k", F.size("x").cast("long").alias("samples"), F.md5(D.wav(F.col("x"), 8000)).alias("m")).collect()
    assert sorted(made) == sorted(want)
