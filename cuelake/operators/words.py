"""When each word of a cue is said.

What a text asks for is a column: its words, the air that each needs, and the cuts that these weights ask for. A cut may not crowd its neighbours:
c(k) = k * least + min(M, max(f0 + least, max over j <= k of g(j) - j * least)), g being the places that the weights give, so no loop is needed.

A tape's frames lie in stretches of ``STRETCH`` frames (level, and whether someone speaks). A cue meets the few stretches that it touches, so a row
holds the frames of a cue and never a tape. In there a cut takes a silence, else the quietest frame within reach.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import signal

#: Shortest word, reach of a search, vowels, those that always open a syllable, apostrophes that don't close one.
WORD_S, SEARCH_MS = 0.06, 140
VOWELS = "aeiouəòóôàâAEIOUƏаеиоуэыәёюяАЕИОУЭЫӘЁЮЯ"
OPENERS, TRANSPARENT = "ёюяЁЮЯ", "ʻʼ’'‘`"
#: A vowel group: a vowel and what goes on with it. The checking SQL reads the same pattern.
SYLLABLE = f"[{VOWELS}][{TRANSPARENT}{''.join(v for v in VOWELS if v not in OPENERS)}]*"
TAG, SOUNDS = r"\A\[[^\]]*\]\z", r"[\p{L}\p{N}]"
STRETCH = 512


def spoken(text: Column) -> Column:
    """Tokens between white space, without [tags] and bare punctuation; none for null."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\s\p{Z}]+"), F.lit(0))
    return F.filter(tokens, lambda t: ~t.rlike(TAG) & t.rlike(SOUNDS))


def weight(word: Column) -> Column:
    """How much air a word needs: its vowel groups, at least one, and a little for each further letter."""
    return F.greatest(F.regexp_count(word, F.lit(SYLLABLE)), F.lit(1)) + F.lit(0.04) * F.greatest(F.length(word) - 1, F.lit(0))


def least_frames(frame_s: float) -> int:
    return max(1, math.ceil(WORD_S / frame_s))


def asked(cues: DataFrame, gates: DataFrame, frame_s: float) -> DataFrame:
    """tape, idx, s, e, lo, duration, words, f0, f1, cuts, reason: the cuts that weights ask for, or why there are none. cues: tape, idx, s, e, text."""
    least, f = least_frames(frame_s), F.col
    rows = cues.join(gates.select("tape", "frames", "lo"), "tape").withColumn("words", spoken(f("text"))).withColumn("duration", f("frames") * F.lit(frame_s))
    n, last = F.size("words"), f("frames") - 1
    low = F.greatest(F.lit(0), F.least(last, F.floor(f("s") / frame_s)))
    rows = rows.withColumns({"n": n, "f0": low.cast("int"), "f1": F.greatest(low, F.least(last, F.ceil(f("e") / frame_s) - 1)).cast("int")})
    span = f("f1") + 1 - f("f0")
    reason = (
        F.when(n == 0, "no_text")
        .when((f("s") >= f("duration")) | (f("e") <= 0), "outside_audio")
        .when(f("e") - f("s") < F.lit(WORD_S) * n, "too_fast")
        .when((n > 1) & (span < n * least), "too_short")
    )
    rows = rows.withColumn("reason", reason).withColumn("weights", F.transform("words", weight)).withColumn("total", F.aggregate("weights", F.lit(0.0), lambda a, x: a + x))
    inner = F.when(f("reason").isNull() & (n > 1), F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    sofar = lambda k: F.aggregate(F.slice("weights", 1, k + 1), F.lit(0.0), lambda a, x: a + x)
    free = F.transform(inner, lambda k: F.rint(f("f0") + span * (sofar(k) / f("total"))).cast("int") - k * least)
    rows = rows.withColumn("free", free)
    highest = f("f1") + 1 - (f("n") - 1) * least
    cuts = F.transform("free", lambda _, k: k * least + F.least(highest, F.greatest(f("f0") + least, F.array_max(F.slice("free", 1, k + 1)))))
    return rows.select("tape", "idx", "s", "e", "lo", "duration", "words", "f0", "f1", cuts.alias("cuts"), "reason")


def stretches(levels: DataFrame, gates: DataFrame) -> DataFrame:
    """tape, stretch, frames (array of f, level, live): a tape in rows of STRETCH frames. Tapes without speech have none."""
    live = signal.live_frames(levels, gates)
    heard = live.filter("live").select("tape").distinct()
    rows = live.join(heard, "tape", "left_semi").withColumn("stretch", F.floor(F.col("f") / STRETCH))
    return rows.groupBy("tape", "stretch").agg(F.array_sort(F.collect_list(F.struct("f", "level", "live"))).alias("frames"))


def silence_centres(live: np.ndarray) -> list[int]:
    """The middle of each stretch of two or more frames without speech, in order."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], live, [True]])))
    return [(a + b - 1) // 2 for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= 2]


def near_silences(cuts: list[int], centres: list[int], first: int, end: int, least: int) -> list[int]:
    """What cuts take of the sorted centres, until one finds none: the nearest that keeps ``least`` frames on both sides and leaves a centre for every later cut."""
    taken, lowest, at = [], 0, first
    for later, cut in zip(range(len(cuts) - 1, -1, -1), cuts, strict=True):
        a = bisect_left(centres, at + least, lowest)
        b = min(bisect_right(centres, end - (later + 1) * least), len(centres) - later)
        if a >= b:
            break
        right = bisect_left(centres, cut, a, b)
        right -= right == b or right > a and cut - centres[right - 1] <= centres[right] - cut
        lowest, at = right + 1, centres[right]
        taken.append(at)
    return taken


def placed(cuts: list[int], level: np.ndarray, live: np.ndarray, first: int, hold: float, frame_s: float) -> tuple[list[int], list[str]]:
    """(frames of the cuts, how each was found) of a cue whose frames begin at ``first``."""
    least, reach, end = least_frames(frame_s), max(1, round(SEARCH_MS / 1000 / frame_s)), first + len(level)
    taken = near_silences(cuts, [first + c for c in silence_centres(live)], first, end, least)
    out, how = list(taken), ["valley"] * len(taken)
    for k, guess in enumerate(cuts[len(taken) :], len(taken)):
        a = max(out[-1] + least if out else first + 1, guess - reach)
        b = min(guess + reach, end - (len(cuts) - k) * least, end - 1)
        cut, kind = guess, "speech"
        if a <= b:
            window = np.arange(a, b + 1)
            quiet = window[level[window - first] < hold]
            kind, window = ("quiet", quiet) if len(quiet) else ("speech", window)
            cut = int(window[np.lexsort((np.abs(window - guess), np.round(level[window - first], 9)))[0]])
        if cut <= (out[-1] if out else first - 1):
            cut, kind = (out[-1] if out else first - 1) + least, "speech"
        out.append(cut)
        how.append(kind)
    return out, how


def word_times(words: list[str], cuts: list[int], first: int, last: int, start: float, end: float, duration: float, frame_s: float) -> list[dict]:
    """Each word with its start and end; the outer ends are the cue's own."""
    at = [round(c * frame_s, 3) for c in (first, *cuts, last + 1)]
    begins, ends = at[:-1], [max(a, b) for a, b in zip(at, at[1:], strict=False)]
    begins[0], ends[-1] = round(min(start, duration), 3), round(min(end, duration), 3)
    begins[1:] = [max(b, e) for b, e in zip(begins[1:], ends, strict=False)]
    return [{"w": w, "s": b, "e": e} for w, b, e in zip(words, begins, ends, strict=True)]


def words_timed(cues: DataFrame, levels: DataFrame, gates: DataFrame, frame_s: float) -> DataFrame:
    """tape, idx, words, methods, reason. cues: tape, idx, s, e, text; levels and gates as in ``signal``. Tapes without speech give no rows."""
    lying = stretches(levels, gates)
    want = asked(cues, gates, frame_s).join(lying.select("tape").distinct(), "tape", "left_semi")
    near = want.filter("reason IS NULL").select("tape", "idx", "f0", "f1", F.explode(F.sequence(F.floor(F.col("f0") / STRETCH), F.floor(F.col("f1") / STRETCH))).alias("stretch"))
    own = F.filter("frames", lambda x: (x["f"] >= F.col("f0")) & (x["f"] <= F.col("f1")))
    parts = near.join(lying, ["tape", "stretch"]).groupBy("tape", "idx").agg(F.array_sort(F.flatten(F.collect_list(own))).alias("frames"))
    rows = want.join(parts, ["tape", "idx"], "left").select("*", F.col("frames.level").alias("level"), F.col("frames.live").alias("live")).drop("frames")

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                words, how = [], []
                if r.reason is None:
                    cuts, how = placed(r.cuts.tolist(), np.array(r.level), np.array(r.live, dtype=bool), r.f0, r.lo, frame_s)
                    words = word_times(r.words.tolist(), cuts, r.f0, r.f1, r.s, r.e, r.duration, frame_s)
                out.append((r.tape, r.idx, words, how, r.reason))
            yield pd.DataFrame(out, columns=["tape", "idx", "words", "methods", "reason"])

    return rows.mapInPandas(run, "tape long, idx long, words array<struct<w:string,s:double,e:double>>, methods array<string>, reason string")
