"""Hard negatives against brute force: odd rows, ties, hot labels, many cells, large components, poor codebooks."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from cuelake.llm import hard_negatives
from cuelake.llm.hard_negatives import FOUND

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, positives string, row string"


def vectors(seed=3, n=900, dims=9, wide=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.4) for _ in range(dims)] for _ in range(4)]
    rows = []
    for k in range(n):
        label = 0 if k % 3 == 0 else rng.randint(0, 9)
        rows.append((k, [wide * (c + rng.gauss(0, 0.25)) for c in centres[label % 4]], label))
    rows += [(1000 + k, list(rows[5][1]), k % 4) for k in range(200)]  # copies with several labels
    rows += [(2000, None, 1), (2001, [0.1] * dims, None), (None, [0.1] * dims, 1), (2050, [float("nan")] * dims, 1), (2003, [None] + [0.1] * (dims - 1), 2), (2004, [float("inf")] * dims, 1)]
    rows += [(2100, [0.0] * dims, 1), (2150, [], 3), (2151, [], 3), (2152, [], 5), (2200, [0.5, 0.25], 1), (2201, [0.5, 0.26], 1), (2202, [0.4, 0.2], 2), (2250, [1.0], 0), (50, [0.3] * dims, 8)]
    return rows


def brute(rows):
    have = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) or abs(np.float32(c)) > 16384 for c in v):
            continue
        have.append((i, label if i % 7 else (label + 1) % 10, [math.floor(256 * float(np.float32(c))) for c in v]))
    out = set()
    first = {}
    for i, label, v in have:
        if i % 50 == 0:
            first[i, len(v)] = min(first.get((i, len(v)), (label, v)), (label, v), key=lambda x: (x[0], np.array(x[1], "<i2" if max(map(abs, x[1] or [0])) < 1 << 15 else "<i4").tobytes()))
    for (i, n), (label, v) in first.items():
        scored = [(sum(a * b for a, b in zip(v, w)), j, name) for j, name, w in have if j != i and len(w) == n]
        same = sorted(((-s, j) for s, j, name in scored if name == label))[:5]
        for less, p in same:
            s = -less
            inside = sorted((-t, j) for t, j, name in scored if name != label and 50 * s <= 100 * t <= 95 * s)[:3]
            out |= {(i, p, r + 1, j, s, -t) for r, (t, j) in enumerate(inside)}
    return out


def run(spark, folder, rows):
    spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    got = hard_negatives.op12_hard_negatives(spark, str(folder))
    assert got.columns == [c.split()[0] for c in FOUND.split(", ")]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("wide", [1.0, 300.0])
def test_query(spark, tmp_path, wide):
    rows = vectors(wide=wide)
    want = brute(rows)
    assert len(want) > 100
    assert run(spark, tmp_path, rows) == want


def test_many_cells_and_a_poor_codebook(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CELL_BYTES", 700)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", 2)
    monkeypatch.setattr(hard_negatives, "codebooks", lambda sample: [np.zeros((1, min(2, sample.shape[1] - at))) for at in range(0, sample.shape[1], 2)])
    rows = vectors(seed=8, n=160)
    assert run(spark, tmp_path, rows) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == set()


def test_intervals_hold_the_score_and_are_narrow():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(0, 0.125, size=(3000, 64))).astype(np.int64)
    books = hard_negatives.codebooks(x)
    code = np.stack([hard_negatives._nearest(x[:, 2 * m : 2 * m + 2].astype(float), b) for m, b in enumerate(books)], axis=1)
    left = np.stack([np.linalg.norm(x[:, 2 * m : 2 * m + 2] - b[code[:, m]], axis=1) for m, b in enumerate(books)], axis=1)
    low, high = hard_negatives.intervals(code, left, x[:20], books)
    score = x @ x[:20].T
    assert (low <= score).all() and (score <= high).all()
    assert (high - low).mean() < 0.25 * (score.max() - score.min())
