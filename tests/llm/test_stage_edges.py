"""Every stage on nulls, empty and wordless texts, ties, repeated rows, an empty table and columns with the operators' own names."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from cuelake.llm import quality_model, toxicity

NAMES = ("score", "size", "rate", "target", "copies", "source_size", "_copy", "_d", "_t", "_doc", "_tkey", "_kept", "_kd", "_kt", "_key", "_number", "_source", "_score", "fp", "set", "h", "label", "rank")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)


def row(i, text, source="a"):
    return (i, text, "en", source, len(text or ""), *NAMES)


LONG = " ".join(f"long{k}" for k in range(30000))
ROWS = [
    row(1, None), row(2, ""), row(3, " \n\t"), row(4, "one line of some length\nanother line of some length"), row(5, "one line of some length\nanother line of some lenght"),
    row(6, LONG), row(6, LONG), row(6, "a text that shares its id with others, and is short"), row(None, "no id here, twice the same text"), row(None, "no id here, twice the same text"),
    row(None, None, None), row(7, "x", None), row(8, "tie tie tie", "b"), row(9, "tie tie tie", "b"), row(10, "Straße über Größe " * 30, ""),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("labels")
    labels = [(4, 1, 0), (5, 0, 1), (6, 1, 0), (7, None, None), (None, 1, 1), (8, 1, 1), (10, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(out / "labels.parquet"))
    return str(out)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame(ROWS, DOCS).repartition(3)
    out = stage(spark, docs, folder)
    got = out.collect()
    none = stage(spark, docs.limit(0), folder)
    assert none.count() == 0
    if name == "packing":
        assert none.columns == out.columns
        assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(r[0] for r in ROWS)
        used = Counter()
        for r in got:
            used[r.sequence_id] += r.length
        assert max(used.values()) <= 4096 and sum(used.values()) == sum(r.length for r in got)
        return
    assert out.columns == docs.columns and none.columns == docs.columns
    assert all(r[n] == n for r in got for n in NAMES)
    texts = Counter((r.doc_id, r.text) for r in got)
    have = Counter((r[0], r[1]) for r in ROWS)
    if name == "toxicity":
        assert texts <= have
    if name == "line_dedup":
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS)
        five = next(r for r in got if r.doc_id == 5)
        assert five.text == "" and five.n_chars == 0
        assert [r.text for r in got if r.doc_id == 1] == [None]
        assert sum(r.text == LONG for r in got) == 2
    if name == "simhash_dedup":
        assert texts <= have and max(texts.values()) == 1
        assert sum(not (t or "").split() for _, t in texts) == 1
        assert (8, "tie tie tie") in texts and (9, "tie tie tie") not in texts
    if name == "mixing":
        assert set(texts) <= set(have) and all(texts[k] <= 2 * have[k] for k in texts)


@pytest.mark.parametrize("module, column", [(toxicity, "toxic"), (quality_model, "quality")])
def test_classifiers_on_empty_tables_and_odd_texts(spark, folder, module, column):
    docs = spark.createDataFrame(ROWS, DOCS)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    everything = F.col("doc_id").isNotNull()
    model = module.fit(docs, labels, everything)
    scored = module.score(docs, model).collect()
    assert len(scored) == len(ROWS) and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if not (r.text or "").split()}) == 1
    assert module.score(docs.limit(0), model).count() == 0
    none = module.fit(docs.limit(0), labels, everything)
    assert all(0 <= r.score <= 1 for r in module.score(docs, none).collect())


def test_many_short_texts_in_one_batch(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"))
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(50)], "doc_id long, quality int, toxic int")
    model = quality_model.fit(docs, labels, F.lit(True))
    assert quality_model.score(docs, model).count() == 20000


def test_words_learnt_from_are_bounded():
    import numpy as np

    label = np.array([0, 0, 0, 1, 1])
    n = np.array([50, 10, 60, 500, 30])
    place = np.array([1, 2, 3, 1, 2])
    take = toxicity.within_budget(label, n, place, 100)
    assert take.tolist() == [True, True, False, False, True]
    assert toxicity.within_budget(label[:4], n[:4], place[:4], 100).tolist() == [True, True, False, True]
