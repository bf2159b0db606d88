"""Word times: the cuts that weights ask for, and what they find, against a search written from the rules."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from cuelake.operators import signal, words


def weights(spark, *texts):
    return [r.w for r in spark.createDataFrame([(t,) for t in texts], "t string").select(words.weight(F.col("t")).alias("w")).collect()]


def test_syllables(spark):
    want = {"bog'ladim": 3, "stol": 1, "o'qish": 2, "keladigan": 4, "ODOB": 2, "бўғла": 1, "қиёма": 3, "100": 1, "a" * 20_000: 1, "ёё": 2}
    assert {w: int(x - 0.04 * (len(w) - 1) + 1e-6) for w, x in zip(want, weights(spark, *want))} == want


def test_spoken(spark):
    rows = spark.createDataFrame([("[S1] men — keldim …",), (None,), ("  ",), ("[a b] x y",)], "t string")
    assert [r.w for r in rows.select(words.spoken(F.col("t")).alias("w")).collect()] == [["men", "keldim"], [], [], ["[a", "b]", "x", "y"]]


def levels_of(tapes):
    return [(t, f, float(x)) for t, xs in tapes.items() for f, x in enumerate(xs)]


def test_words_take_the_pauses(spark):
    # speech 0-.60, pause -.75, speech -1.25, pause -1.37, speech -2.07
    tape = [0.3] * 30 + [0.001] * 8 + [0.3] * 25 + [0.001] * 6 + [0.3] * 35
    levels = spark.createDataFrame(levels_of({1: tape, 2: [0.0] * 100}), "tape long, f int, level double")
    cues = [(1, 0, 0.0, 2.07, "salom dunyo yaxshi"), (1, 1, 0.0, 0.1, "a b c d e f"), (1, 2, 90.0, 95.0, "x"), (1, 3, 0.0, 1.0, "[S1] …"), (1, 4, 0.0, 1.0, None), (1, 5, 2.04, 3.0, "a b c d"), (2, 0, 0.0, 1.0, "silent")]
    got = {(r.tape, r.idx): r for r in words.words_timed(spark.createDataFrame(cues, "tape long, idx long, s double, e double, text string"), levels, signal.gates(levels), 0.02).collect()}
    assert {k: r.reason for k, r in got.items()} == {(1, 0): None, (1, 1): "too_fast", (1, 2): "outside_audio", (1, 3): "no_text", (1, 4): "no_text", (1, 5): "too_short"}
    first = got[1, 0]
    assert first.methods == ["valley", "valley"]
    assert 0.60 <= first.words[0].e <= 0.76 and 1.25 <= first.words[1].e <= 1.38 and first.words[-1].e == 2.07


def silent_middles(live):
    """Runs of at least two silent frames, frame by frame."""
    out, run = [], []
    for f, on in enumerate([*live, True]):
        if on:
            if len(run) > 1:
                out.append((run[0] + run[-1]) // 2)
            run = []
        else:
            run.append(f)
    return out


def brute(cuts, level, live, first, hold, frame_s):
    """By definition: each cut in turn looks through all silences, then through all frames within reach."""
    least, reach, end = words.least_frames(frame_s), max(1, round(0.14 / frame_s)), first + len(level)
    silences, out, how, used, dry = [first + c for c in silent_middles(live)], [], [], set(), False
    for k, cut in enumerate(cuts):
        later = len(cuts) - k - 1
        fits = [c for c in silences if c not in used and c - (out[-1] if out else first) >= least and end - c >= (later + 1) * least and sum(x > c and x not in used for x in silences) >= later]
        if fits and not dry:
            out.append(min(fits, key=lambda c: (abs(c - cut), c)))
            used.add(out[-1])
            how.append("valley")
            continue
        dry, before = True, out[-1] if out else None
        window = [f for f in range(first, end) if abs(f - cut) <= reach and f >= (first + 1 if before is None else before + least) and end - f >= (later + 1) * least]
        quiet = [f for f in window if level[f - first] < hold]
        at, kind = cut, "speech"
        if window:
            at, kind = min(quiet or window, key=lambda f: (round(float(level[f - first]), 9), abs(f - cut), f)), "quiet" if quiet else "speech"
        if at <= (first - 1 if before is None else before):
            at, kind = (first - 1 if before is None else before) + least, "speech"
        out.append(at)
        how.append(kind)
    return out, how


def test_placed_against_all_frames():
    rng = random.Random(4)
    seen = set()
    for _ in range(600):
        n, frame_s = rng.randint(6, 120), rng.choice([0.02, 0.5])
        level = np.array([rng.choice([0.3, 0.2, 0.001, 0.002]) for _ in range(n)])
        live = np.array([rng.random() < 0.7 for _ in range(n)])
        least, first = words.least_frames(frame_s), rng.randint(0, 50)
        k = rng.randint(0, min(8, n // least - 1))
        cuts = sorted(first + c for c in rng.sample(range(least, n - least + 1), k)) if k else []
        got = words.placed(cuts, level, live, first, 0.05, frame_s)
        assert got == brute(cuts, level, live, first, 0.05, frame_s)
        seen |= set(got[1])
    assert seen == {"valley", "quiet", "speech"}


def test_long_tapes_in_stretches_give_what_one_stretch_gives(spark, monkeypatch):
    rng = random.Random(6)
    tape = []
    while len(tape) < 3000:
        tape += [rng.uniform(0.2, 0.4) for _ in range(rng.randint(5, 40))] + [rng.uniform(0.0005, 0.003) for _ in range(rng.choice([0, 2, 5, 9]))]
    levels = spark.createDataFrame(levels_of({7: tape}), "tape long, f int, level double")
    cues = spark.createDataFrame([(7, k, k * 2.3, k * 2.3 + 2.2, "men bugun maktabga keldim va ketdim") for k in range(26)], "tape long, idx long, s double, e double, text string")
    found = []
    for size in (100_000, 64):
        monkeypatch.setattr(words, "STRETCH", size)
        found.append(sorted(words.words_timed(cues, levels, signal.gates(levels), 0.02).collect()))
    assert found[0] == found[1] and len(found[0]) == 26
