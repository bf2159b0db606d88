"""Streams over files: state that goes, tickets used once, hooks; sign-ins; providers as functions over rows."""

from __future__ import annotations

import hashlib
import hmac
from datetime import datetime, timedelta
from urllib.parse import urlencode

from pyspark.sql import functions as F

from cuelake.functions.checks import progress
from cuelake.sources import choice
from cuelake.streaming import stateful as S

T0 = datetime(2024, 1, 1)


def _run(q):
    q.processAllAvailable()
    q.stop()


def test_state_of_admission_goes_when_the_watermark_has_passed(spark, tmp_path):
    src, ck = str(tmp_path / "hits"), str(tmp_path / "ck")
    schema = "id long, key long, at timestamp"
    stream = spark.readStream.schema(schema).parquet(src) if spark.createDataFrame([], schema).write.parquet(src) is None else None
    q = S.admitted_stream(stream, 60.0, 2, "10 seconds").writeStream.format("memory").queryName("adm2").option("checkpointLocation", ck).outputMode("append").start()
    for rows in ([(1, 1, T0), (2, 1, T0 + timedelta(seconds=5)), (3, 1, T0 + timedelta(seconds=6))], [(4, 2, T0 + timedelta(seconds=600))], [(5, 2, T0 + timedelta(seconds=601))], [(6, 1, T0 + timedelta(seconds=700))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q.processAllAvailable()
    rows = [p["numRowsTotal"] for x in q.recentProgress for p in x["stateOperators"]]
    q.stop()
    got = {r.id: r.admitted for r in spark.table("adm2").collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True}
    assert 1 in rows[rows.index(max(rows)) :], rows


def test_single_use_on_a_stream(spark, tmp_path):
    src = str(tmp_path / "tickets")
    rows = [("a", T0), ("a", T0 + timedelta(seconds=3)), ("b", T0)]
    spark.createDataFrame(rows, "ticket string, at timestamp").write.parquet(src)
    stream = spark.readStream.schema("ticket string, at timestamp").parquet(src)
    q = S.single_use(stream, ["ticket"], "at", S.TICKET_TTL).writeStream.format("memory").queryName("once").outputMode("append").start()
    _run(q)
    assert sorted(r.ticket for r in spark.table("once").collect()) == ["a", "b"]


def test_fan_out_on_a_stream(spark, tmp_path):
    src = str(tmp_path / "events")
    spark.createDataFrame([(1, 10, "asr"), (2, 10, "done"), (3, 11, "failed"), (4, 99, "done")], "id long, job_id long, step string").write.parquet(src)
    jobs = spark.createDataFrame([(10, 7), (11, 8)], "id long, user_id long")
    hooks = spark.createDataFrame([(1, 7, "done, failed"), (2, 7, "failed"), (3, 8, "failed")], "id long, user_id long, events string")
    stream = spark.readStream.schema("id long, job_id long, step string").parquet(src)
    q = S.fanned_out(stream, jobs, hooks, progress(F.col("step"))).writeStream.format("memory").queryName("fan").outputMode("append").start()
    _run(q)
    got = sorted(tuple(r) for r in spark.table("fan").collect())
    assert got == [(1, 7, "frame", "40"), (2, 7, "call", "1"), (2, 7, "frame", "100"), (2, 7, "notice", "job_done"), (3, 8, "call", "3"), (3, 8, "frame", "100"), (3, 8, "notice", "job_failed")]
    done = S.terminal_notices(spark.createDataFrame([(2, 7, "done")], "id long, user_id long, step string"), spark.createDataFrame([(7, 1, "done"), (7, 2, "failed")], "user_id long, webhook_id long, event string"), ["done"])
    assert [tuple(r) for r in done.collect()] == [(2, 7, "done", 1)]


def test_sign_ins(spark):
    token, now = "123:secret", 1_700_000_000

    def data(at, user='{"id": 5}', key=token, **more):
        fields = {"auth_date": str(at), "user": user, **more}
        lines = "\n".join(f"{k}={fields[k]}" for k in sorted(fields))
        secret = hmac.new(b"WebAppData", key.encode(), hashlib.sha256).digest()
        return urlencode(fields | {"hash": hmac.new(secret, lines.encode(), hashlib.sha256).hexdigest()})

    rows = [(1, data(now)), (2, data(now, x="é")), (3, data(now - 7 * 3600)), (4, data(now + 91)), (5, data(now, key="other")), (6, data(now, user="{}")), (7, ""), (8, None), (9, data("soon")), (10, data(now - 5))]
    out = S.signed(spark.createDataFrame(rows, "id long, data string"), token, F.lit(now))
    assert {r.id: r.code for r in out.collect()} == {1: None, 2: None, 3: "too_old", 4: "from_the_future", 5: "bad_hash", 6: "no_user", 7: "no_time", 8: "no_time", 9: "no_time", 10: None}
    assert {r.id: r.fresh for r in S.used_once(out).collect()} == {1: True, 2: False, 10: True}


def test_queue_drops_what_it_cannot_hold(spark):
    rows = [(k, 1, T0 + timedelta(milliseconds=k)) for k in range(70)] + [(100, 1, T0 + timedelta(seconds=5)), (101, 2, T0)]
    got = {r.id: r.delivered for r in S.delivered(spark.createDataFrame(rows, "id long, key long, at timestamp"), "1 second").collect()}
    assert [k for k, ok in got.items() if not ok] == list(range(64, 70))


def test_providers(spark):
    files = spark.createDataFrame([("/a.mp3", "uz"), ("/b.mp3", "ru")], "path string, lang string")
    got = choice.recognised(files, lambda path, lang: [(0.0, 1.0, f"{path} {lang}")] * 2).collect()
    assert [(r.path, r.pos, r.text) for r in sorted(got)] == [("/a.mp3", 0, "/a.mp3 uz"), ("/a.mp3", 1, "/a.mp3 uz"), ("/b.mp3", 0, "/b.mp3 ru"), ("/b.mp3", 1, "/b.mp3 ru")]
    texts = spark.createDataFrame([("x",), (None,), ("x",)], "t string")
    assert [r.u for r in texts.select(choice.translated(F.col("t"), lambda ts: [t.upper() for t in ts]).alias("u")).collect()] == ["X", None, "X"]
