"""The pipeline's near-copy stage against brute force."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from cuelake.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, extra string"


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def texts():
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(400)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows = []
    for n in (*range(1, 13), *[30, 60, 120, 300] * 8):
        base = make(n)
        rows.append(" ".join(base))
        for edits in (1, max(1, n // 60), n // 45, n // 30):
            near = list(base)
            for _ in range(edits):
                near[rng.randrange(len(near))] = rng.choice(vocab)
            rows.append(" ".join(near) + (" tail" if rng.random() < 0.3 else ""))
    rows += ["the same words in front of all " + " ".join(make(25)) for _ in range(40)]
    rows += [rows[3], rows[3].upper(), "", None, " \n", " ".join(make(9000))]
    return list(enumerate(rows)) + [(5, rows[5]), (None, rows[9])]


@pytest.mark.parametrize("hot, cell", [(128, 512), (3, 7), (0, 512)])
def test_every_pair_is_found(spark, monkeypatch, hot, cell):
    made = near_copies.keep_first
    monkeypatch.setattr(near_copies, "keep_first", lambda docs: made(docs, hot=hot, cell=cell))
    rows = texts()
    sets = [shingles(t) for _, t in rows]
    parent = {s: s for s in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked, far, different = set(), 0, list(parent)
    for n, a in enumerate(different):
        for b in different[n + 1 :]:
            both = len(a & b)
            if both and both * 5 >= 4 * len(a | b):
                linked.add(frozenset((a, b)))
                parent[find(a)] = find(b)
    of = {s: next(t for (_, t), x in zip(rows, sets, strict=True) if x == s) for s in different}
    far = sum((simhash.fingerprint(of[a]) ^ simhash.fingerprint(of[b])).bit_count() > 3 for a, b in linked)
    assert far > 20
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(3)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    got = kept.collect()
    assert Counter(find(shingles(r.text)) for r in got) == Counter({find(s): 1 for s in different})
    least = {}
    for (i, _), s in zip(rows, sets, strict=True):
        least[find(s)] = min(least.get(find(s), 1 << 62), 1 << 62 if i is None else i)
    assert all(r.doc_id == least[find(shingles(r.text))] for r in got)
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_prefixes_lose_no_pair():
    for x in range(1, 120):
        for y in range(1, x + 1):
            need = -(-4 * (x + y) // 9)
            if need <= y and need * 5 >= 4 * (x + y - need):
                assert near_copies.least_shared(np.array(x), np.array(y)) == need
                assert near_copies.least_in_prefixes(np.array(x), np.array(y)) >= 1


def test_rows_grow_with_a_groups_sets_not_its_pairs(spark):
    words = [f"v{k}" for k in range(60)]
    docs = spark.createDataFrame([(k, " ".join([*words, f"end{k}"])) for k in range(700)], "doc_id long, text string")
    pairs, cells = near_copies.candidates(docs.select("text"), 5, hot=64)
    assert pairs.count() < 700 * 64 and cells.count() <= 700 * 60 * 3
    assert [r.doc_id for r in near_copies.keep_first(docs, hot=64).collect()] == [0]
