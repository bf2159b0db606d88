"""Flag files brought up to date, table functions in SQL, and counters of tables and streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from cuelake.functions import tables
from cuelake.operators import flags
from cuelake.sources import timedtext
from cuelake.streaming import metrics


def by_hand(text):
    try:
        found = json.loads(text) if text is not None else {}
    except ValueError:
        found = {}
    found = found if isinstance(found, dict) else {}
    out = {k: (v, "kept") for k, v in found.items()}
    for k, v in flags.DEFAULTS.items():
        if k not in found:
            out[k] = (v, "default")
        elif not isinstance(found[k], dict):
            out[k] = (v, "coerced")
        elif found[k] == flags.STALE.get(k):
            out[k] = (v, "upgraded")
    return out


def test_flag_files(spark):
    texts = [
        None, "", "{", "[]", "1", '"x"', "null", "{}", '{"job_sharing": null}', '{"api_keys": "{}"}', '{"webhook_out": [1]}', '{"other": 7, "more": {"a": [1, {"b": null}]}}',
        '{"webhook_out": {"pct": 0, "min_plan": "studio", "enabled": false}}', '{"webhook_out": {"pct": 0.0, "min_plan": "studio", "enabled": false}}',
        '{"webhook_out": {"pct": 1, "min_plan": "studio", "enabled": false}, "batch_jobs": {"enabled": false, "min_plan": "studio", "pct": 10}}',
        '{"batch_jobs": {"enabled": false, "min_plan": "studio", "pct": 10, "x": 1}}', '{"batch_jobs": {"enabled": "no", "min_plan": "studio", "pct": 10}}', '{"uzbek_language_engine": {"enabled": false}}',
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r.id, r.flag): (json.loads(r.value), r.origin) for r in flags.reconciled(rows, "id", "text").collect()}
    assert got == {(k, name): v for k, t in enumerate(texts) for name, v in by_hand(t).items()}
    assert flags.reconciled(rows.limit(0), "id", "text").count() == 0


def test_table_functions(spark):
    tables.register(spark)
    rows = [(1, "bir  ikki\nuch"), (2, ""), (3, None), (4, " x ")]
    spark.createDataFrame(rows, "id int, t string").createOrReplaceTempView("said")
    got = spark.sql("SELECT s.id, k.pos, k.token FROM said s, LATERAL tokens(s.t) k ORDER BY 1, 2").collect()
    assert [tuple(r) for r in got] == [(1, 0, "bir"), (1, 1, "ikki"), (1, 2, "uch"), (4, 0, "x")]
    cuts = spark.sql("SELECT * FROM illegal_cuts('rejani hozir uchun yozdik')").collect()
    assert [tuple(r) for r in cuts] == [(2, 1)]


def test_parse_srt_gives_what_the_columns_give(spark):
    tables.register(spark)
    files = [
        "1\n00:00:01,000 --> 00:00:02,500\nSalom\n\n2\n00:00:03.5 --> 00:00:04,25\nIkki\nqator\n", "00:00:01,000 --> 00:00:02,000\nNo number\n\nnoise\n\n7\n00:01:00,000 --> 00:01:01,000\n\n",
        "", None, "x\ny", "a\n00:00:01,000 --> 00:00:02,000\nNamed by a word", "1\r\n00:00:01,000 --> 00:00:02,000\r\nCRLF\r\n\r\n2\r\n00:00:02,000 --> 00:00:03,000\r\nB", "1\n\t\n00:00:01,000 --> 00:00:02,000 00:00:03,000\nThree",
        "  \n3\n00:00:01,000 -> 1:00:02,000\nArrow",
    ]
    df = spark.createDataFrame(list(enumerate(files)), "id int, content string")
    df.createOrReplaceTempView("files")
    want = sorted(tuple(r) for r in timedtext.parse_srt(df).select("id", "pos", "idx", "start", "end", "text").collect())
    got = sorted(tuple(r) for r in spark.sql("SELECT f.id, p.* FROM files f, LATERAL parse_srt(f.content) p").collect())
    assert got == want and len(got) >= 6


def test_counters_of_a_table(spark):
    rows, seen = metrics.observed(spark.range(100), "r", {"even": F.col("id") % 2 == 0, "big": F.col("id") > 89})
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"even": 50, "big": 10}


def test_counters_of_a_stream_add_up(spark, tmp_path):
    src = str(tmp_path / "in")
    counters = metrics.Counters()
    spark.streams.addListener(counters)
    try:
        for part in range(3):
            spark.range(part * 10, part * 10 + 10).coalesce(1).write.mode("append").parquet(src)
            rows, seen = metrics.observed(spark.readStream.schema("id long").parquet(src), "frames", {"published": F.col("id") % 5 > 0, "dropped": F.col("id") % 5 == 0})
            assert seen is None
            q = rows.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        assert counters.sums == {("frames", "published"): 24, ("frames", "dropped"): 6}
    finally:
        spark.streams.removeListener(counters)
    told = metrics.lines("counter", "frames_total", "Frames.", {f'{{result="{k}"}}': n for (_, k), n in sorted(counters.sums.items())})
    assert told == ["# HELP frames_total Frames.", "# TYPE frames_total counter", 'frames_total{result="dropped"} 6', 'frames_total{result="published"} 24']
