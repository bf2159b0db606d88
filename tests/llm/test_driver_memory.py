"""What the driver holds: plans of few leaves, and a network's parameters packed part by part."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from cuelake.llm import graph, lines, toxicity


def leaves(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_rounds_of_components_plan_a_frame_twice(spark, monkeypatch):
    rng, seen, cut = random.Random(5), [], graph.cut
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2050)] + [(7, 7), (None, 3), (9, None)]
    monkeypatch.setattr(graph, "cut", lambda df: (seen.append(leaves(df)), cut(df))[1])
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    above = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}

    def root(x: int) -> int:
        while above[x] != x:
            x = above[x]
        return x

    for a, b in edges:
        if a in above and b in above and root(a) != root(b):
            above[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {x: root(x) for x in above}
    assert len(seen) > 4 and max(seen) <= 2


def test_components_of_no_edges(spark):
    assert graph.components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).collect() == []


def test_classes_of_lines_plan_no_rounds(spark):
    text = "a line that is long enough to be linked"
    docs = spark.createDataFrame([(1, text), (2, text + "s\nother"), (3, "x" + text)], "doc_id long, text string")
    _, classes = lines.line_classes(docs)
    assert leaves(classes) <= 4
    assert sorted(r.n_links for r in classes.collect()) == [0, 2, 2, 2]


def test_parameters_are_packed_in_parts():
    live = np.random.default_rng(1).random(3 * toxicity.BUCKETS) < 0.9
    state = toxicity.State.start(live, 3)
    size = int(live.sum()) * (4 + 6 * toxicity.DIM)
    tracemalloc.start()
    given = state.given()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * size
    again = toxicity.State.taken(*given)
    assert (again.live == live).all() and (again.network.table == state.network.table).all()
    assert np.allclose(again.rows, state.rows, rtol=0.01) and (again.dense() == state.dense()).all()


def test_means_reach_the_driver_as_arrow(spark, monkeypatch):
    """The payloads of a round are never rows of the driver's Python."""
    docs = spark.createDataFrame([(k, f"words {'bad' if k % 2 else 'good'} w{k % 9}") for k in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, toxic int")
    frame, kinds = type(docs), []
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: (kinds.extend(t for _, t in self.dtypes), collect(self))[1])
    model = toxicity.fit(docs, labels, F.lit(True))
    assert "binary" not in kinds
    scored = toxicity.score(docs, model).collect()
    assert all((r.score >= toxicity.CUT) == bool(r.doc_id % 2) for r in scored)
