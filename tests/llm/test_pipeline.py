"""The pipeline's stages on the smallest tables."""

from __future__ import annotations

import corpus_pipeline
import pyarrow.parquet as pq


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / f"{k}")
        stage(spark, docs, sf).write.parquet(out)
        docs = spark.read.parquet(out)
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns
        if name == "line_dedup":
            assert counts[-1] == counts[-2]
    ids = set(pq.read_table(f"{sf}/documents.parquet", columns=["doc_id"])["doc_id"].to_pylist())
    assert {r.doc_id for r in docs.select("doc_id").collect()} <= ids
    assert counts[1] >= 0.5 * counts[0] and counts[3] <= counts[2]
    assert docs.groupBy("sequence_id").sum("length").filter("`sum(length)` > 4096").count() == 0


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
