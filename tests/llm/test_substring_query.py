"""op10_substrings against brute force: passages shared whole, in part and at both edges; common phrases; hot anchors."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cuelake.llm import substrings


def table():
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(150)] + ["É", "#x"]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, phrase, line = make(70), make(12), make(25)
    rows = []
    for k in range(160):
        t = make(rng.randint(0, 50))
        if k % 2:
            a, b = rng.randint(0, 20), rng.randint(45, 70)
            t += passage[a:b]
        if k % 3 == 0:
            t += make(4) + phrase
        t += make(rng.randint(0, 40))
        if k % 5 == 0:
            t += line + make(3) + line
        rows.append((k, " ".join(t)))
    rows += [(200 + k, rows[3][1]) for k in range(9)] + [(300, "z " * 400), (301, "z " * 25), (302, "a b " * 50), (303, None), (304, ""), (305, " ".join(make(15))), (4, rows[4][1]), (306, " \n".join(make(9000)))]
    rng.shuffle(rows)
    return rows


def brute(rows):
    keyed = sorted((i, t or "") for i, t in rows)
    first, want = {}, Counter()
    for i, t in keyed:
        w = t.encode().split()
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s : s + 20]), (i, t, s))
    for i, t in keyed:
        w = t.encode().split()
        gone = {k for s in range(len(w) - 19) if first[tuple(w[s : s + 20])] != (i, t, s) for k in range(s, s + 20)}
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want[i, len(w), len(gone), hashlib.sha256(left).hexdigest()] += 1
    return want


@pytest.mark.parametrize("hot", [(4096, 256), (5, 256), (4096, 3), (2, 1)])
def test_query(spark, tmp_path, hot, monkeypatch):
    rows = table()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    made = substrings.remove_repeats
    monkeypatch.setattr(substrings, "remove_repeats", lambda docs, with_text: made(docs, with_text=with_text, hot=hot[0], task_hot=hot[1]))
    got = Counter(tuple(r) for r in substrings.op10_substrings(spark, str(tmp_path)).collect())
    assert got == brute(rows)


def test_null_ids_with_different_texts(spark):
    rows = [(None, " ".join(f"{k}a{j}" for j in range(30))) for k in range(200)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False).collect()
    assert len(got) == 200 and not any(r.n_removed for r in got)


def test_extension_matches_word_by_word():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 2, 400).astype("<u4")
    parts, starts = [], [0, 40, 80, 200, 330]
    for s in starts:
        cols = (np.array([1]), np.array([7]), np.array([s]), np.array([0]), np.array([0]), np.array([3]), np.array([2]), words[s : s + 8])
        kinds = ("<u4", "<u8", "<i8", "<i8", "<u4", "<u4", "<u4", "<u4")
        parts.append(b"".join(c.astype(k).tobytes() for c, k in zip(cols, kinds, strict=True)))
    # windows of 6 words, anchors of 1 word at place 2 of the first of three windows
    got = {(d, tuple(np.frombuffer(p, "<u4").tolist())) for d, _, p in substrings.extend(parts, 6, 1)}
    want, seen = {}, {}
    for s in starts:
        for j in range(3):
            # the anchor's own word goes by its hash, here the same for all
            w = words[s + j : s + j + 6].copy()
            w[2 - j] = 9
            if seen.setdefault((j, w.tobytes()), s) != s:
                want.setdefault(s, []).append(j)
    assert {d: sorted(k for a, b in zip(p[::2], p[1::2]) for k in range(a, b)) for d, p in got} == want
