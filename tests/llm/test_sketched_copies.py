"""The near-copy stage searches by SimHash before the exact join completes it."""

from __future__ import annotations

import random

import corpus_pipeline

from cuelake.llm import near_copies, simhash


def texts():
    rng = random.Random(5)
    rows = []
    for n in [80, 200, 400] * 6:
        base = [f"w{rng.randrange(500)}" for _ in range(n)]
        rows.append(" ".join(base))
        for at in (0, n // 2):
            near = list(base)
            near[at] = "other"
            rows.append(" ".join(near))
    return rows


def test_sketched_joins_near_fingerprints(spark):
    fps = [simhash.fingerprint(t) for t in texts()]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    sets = spark.createDataFrame(list(enumerate(signed)), "set long, fp long")
    parent = list(range(len(fps)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= near_copies.BITS:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    want = {(find(k), k) for k in range(len(fps)) if find(k) != k}
    assert want and {(r.a, r.b) for r in near_copies.sketched(sets).collect()} == want


def test_stage_verifies_what_simhash_links_once(spark, monkeypatch):
    asked, made = [], near_copies.verified

    def verified(pairs, *rest):
        asked.append({frozenset((r.a, r.b)) for r in pairs.collect()})
        return made(pairs, *rest)

    monkeypatch.setattr(near_copies, "verified", verified)
    rows = texts()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, len(rows), 3))
    near, left = asked
    assert near and left and not near & left


def test_pairs_with_a_common_head_are_left_out(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (-5, 1), (8, 9)], "a long, b long")
    links = spark.createDataFrame([(1, 2), (1, 3), (-5, 6)], "a long, b long")
    assert sorted(tuple(r) for r in near_copies.not_joined(pairs, links).collect()) == [(-5, 1), (3, 4), (8, 9)]
