"""op7 learns from every labelled text, in one shard or many."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cuelake.llm import toxicity

TOXIC, CLEAN = 2900, 600


@pytest.mark.parametrize("most", [{}, {"shard_bytes": 20_000}])
def test_every_labelled_text_counts(spark, most):
    """400 toxic texts, the last by the hash of the id behind 2,500 others, are the only ones with a word."""
    ids = [r.id for r in spark.range(TOXIC + CLEAN).orderBy(F.xxhash64("id")).collect()]
    toxic, clean = ids[:2500] + ids[-400:], ids[2500:-400]
    rows = [(i, f"here are words zorgon and w{n % 50}", 1) for n, i in enumerate(toxic[:2500])]
    rows += [(i, f"here are words plimf and w{n % 50}", 1) for n, i in enumerate(toxic[2500:])]
    rows += [(i, f"here are words and w{n % 50} w{n % 7}", 0) for n, i in enumerate(clean)]
    assert len(rows) == TOXIC + CLEAN
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True), **most)
    asked = spark.createDataFrame([(1, "some plimf here"), (2, "some zorgon here"), (3, "here are words and w3 w4")], "doc_id long, text string")
    got = {r.doc_id: r.score >= toxicity.CUT for r in toxicity.score(asked, model).collect()}
    assert got == {1: True, 2: True, 3: False}


def test_shards_hold_every_labelled_text_once(spark):
    docs = spark.createDataFrame([(k, "one two three " * (k % 5)) for k in range(300)] + [(7, "a"), (None, "x"), (8, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(900, 1), (3, None), (4, 1)], "doc_id long, toxic int")
    rows = toxicity.shards(docs, labels, F.lit(True), 1000).collect()
    assert len(rows) == 200 and len({r.shard for r in rows}) > 3
    assert sum(r.label for r in rows) == 101
    # of two texts of an id the lesser one is learnt from: 7 has six words or one
    assert sum(r.n for r in rows) == sum(3 * (k % 5) for k in range(200)) - 6 + 1


def test_a_long_text_in_pieces_wins_like_a_whole_one(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 50, (n, 3)).astype("<u2") for n in (0, 1, 2, 3, 40, 97)]
    m = toxicity.State.start(np.ones(3 * toxicity.BUCKETS, dtype=bool), 3).network
    whole = toxicity.winners(m, texts)
    monkeypatch.setattr(toxicity, "AT_ONCE", 7)
    pieces = toxicity.winners(m, texts)
    assert np.allclose(whole[0], pieces[0], atol=1e-5)
    raw = [float(toxicity._activity(m, whole[0][k : k + 1], np.array([len(t)]))[1][0]) for k, t in enumerate(texts)]
    shift = toxicity._SHIFT
    assert np.allclose(raw[1:], [m.raw(t.astype(np.int32) + shift, np.array([0, len(t)]))[0] for t in texts[1:]], atol=1e-5)
