"""Captions against a plain assembly, previews, and requests that are refused."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from cuelake.operators import captions as C


def plain(cues, words, lines, cues_most, words_most):
    out, used, cut = [], 0, len(cues) > cues_most
    for n, (_, s, e, text) in enumerate(cues[:cues_most], 1):
        m = re.match(r"\[S(\d+)\]\s*", text or "")
        who, text = (int(m[1]), text[m.end() :]) if m else (None, text or "")
        said = [w for w in words.get(n, []) if w[0]]
        cut = cut or used >= words_most or used + len(said) > words_most
        said = said[: max(0, words_most - used)]
        used += len(said)
        if who is None:
            best = max(((min(le, e) - max(ls, s), -k, v) for k, (v, ls, le) in enumerate(lines)), default=(0, 0, None))
            who = best[2] if best[0] > 0 else None
        out.append((n, s, e, text[:600], who, [(w[:120], a, b) for w, a, b in said], len(cues), cut))
    return out


@pytest.mark.parametrize("words_most", [0, 7, 40, 10_000])
def test_assembled(spark, words_most):
    rng = random.Random(words_most)
    docs = {}
    for d in range(12):
        cues = [(i, round(i * 2.0, 3), round(i * 2.0 + rng.choice([0.5, 2.0, 5.0]), 3), rng.choice([None, "", "[S0] x", "[S12]", "[S2]  Ha", "Salom " * 150, "yo'q"])) for i in range(rng.randint(1, 9))]
        words = {n: [(rng.choice(["a", "", None, "b" * 200]), 1.0, 2.0) for _ in range(rng.randint(0, 12))] for n in range(1, 12) if rng.random() < 0.7}
        lines = [(rng.choice([1, 2, 3, None]), s, s + rng.choice([1.0, 3.0])) for s in (rng.uniform(0, 20) for _ in range(rng.randint(0, 6)))]
        docs[d] = (cues, words, lines)
    make = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    cues = make([(d, *c) for d, (cs, _, _) in docs.items() for c in cs], "doc long, idx long, start double, end double, text string")
    words = make([(d, n, w) for d, (_, ws, _) in docs.items() for n, w in ws.items()], "doc long, i int, words array<struct<w:string,s:double,e:double>>")
    lines = make([(d, k, *x) for d, (_, _, ls) in docs.items() for k, x in enumerate(ls)], "doc long, line long, speaker int, rs double, re double")
    found = C.assembled(cues, words, lines, 6, words_most)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.doc, r.n)):
        got.setdefault(r.doc, []).append((r.n, r.start, r.end, r.text, r.speaker, [tuple(w) for w in r.words], r.total, r.truncated))
    assert got == {d: plain(*x, 6, words_most) for d, x in docs.items()}
    for r in C.summed(found).collect():
        own = got[r.doc]
        assert (r["count"], r.total, r.words, r.karaoke, r.truncated) == (len(own), own[0][6], sum(len(x[5]) for x in own), any(x[5] for x in own), own[-1][7])
        assert r.speakers == any(x[4] is not None for x in own)


def test_previews(spark):
    rows = [(1, k, k * 1.0, k + 0.5, t) for k, t in enumerate(["[S2]  a\n b", "[S0] zero", None, "x" * 400])] + [(2, k, float("nan"), 1.0, "y") for k in range(70)]
    got = C.previews(spark.createDataFrame(rows, "doc long, idx long, start double, end double, text string")).orderBy("doc", "n").collect()
    assert [r.line for r in got if r.doc == 1] == ["00:00:00,000 --> 00:00:00,500  [S2] a b", "00:00:01,000 --> 00:00:01,500  zero", "00:00:02,000 --> 00:00:02,500  ", "00:00:03,000 --> 00:00:03,500  " + "x" * 300]
    assert sum(r.doc == 2 for r in got) == 60 and {r.total for r in got if r.doc == 2} == {70}


def cue(k, start="00:00:01,000", end="00:00:02,000", text="x"):
    return f"{k}\n{start} --> {end}\n{text}\n"


@pytest.mark.parametrize(
    ("body", "code", "at"),
    [
        (None, "no_srt", None), (" \n", "no_srt", None), (cue(1), None, None), ("no times", None, None), (cue(1, text="x" * 5000), "srt_too_long", None),
        (cue(1) + "\n" + cue(5, end="24:00:00,001"), "bad_timing", 5), (cue(1, start="00:00:03,000"), "bad_timing", 1), (cue(1, start="24:00:00,000", end="24:00:00,000"), None, None),
        (cue(1, text="x" * 300) + "\n" + cue(2, text="x" * 301), "text_too_long", 2), (cue(1, text="x" * 301) + "\n" + cue(2, end="99:00:00,000"), "bad_timing", 2),
    ],
)
def test_requests(spark, body, code, at):
    df = spark.createDataFrame([(body,)], "b string")
    [r] = df.select(C.requested(F.col("b")).alias("r")).select("r.*").collect()
    assert (r.code, r.at, r.cues is None) == (code, at, code is not None)
    [loose] = df.select(C.requested(F.col("b"), strict=False).alias("r")).select("r.*").collect()
    assert loose.code == (None if code == "text_too_long" else code)
    assert all(len(c.text) <= 300 for c in loose.cues or [])
