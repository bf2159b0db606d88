"""Sessions as a table and as a stream, and folds over a user with a third of all rows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone
from decimal import Decimal

from cuelake.operators import sessions
from cuelake.streaming import stateful

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
HOLD, STEP = 7200, 1800


def by_hand(times, hold=HOLD, step=STEP):
    """(first, last, requests, renewals, expires) of each session of one user's times, in order."""
    out = []
    for t in times:
        if not out or t > out[-1][4]:
            out.append([t, t, 1, 1, t + hold])
            continue
        s = out[-1]
        s[1], s[2] = t, s[2] + 1
        if t - (s[4] - hold) > step:
            s[3], s[4] = s[3] + 1, t + hold
    return [tuple(s) for s in out]


def requests():
    rng = random.Random(7)
    rows, by = [], {}
    for user in (None, 1, 2, 3):
        t, times = 0, []
        for _ in range(60):
            t += rng.choice([0, 1, 60, 900, 1800, 1801, 5400, 7200, 7201, 9000, 20000])
            times.append(t)
        by[user] = times
        rows += [(user, t) for t in times]
    at = lambda t: T0 + timedelta(seconds=t)
    return [(k, u, at(t)) for k, (u, t) in enumerate(sorted(rows, key=lambda r: r[1]))], by


EPOCH = int(T0.timestamp())
SCHEMA = "id long, user_id long, at timestamp"


def test_sessions(spark):
    rows, by = requests()
    got = sorted((str(r.user_id), r.first - EPOCH, r.last - EPOCH, r.requests, r.renewals, r.expires - EPOCH) for r in sessions.sessions(spark.createDataFrame(rows, SCHEMA).repartition(3), HOLD, STEP).collect())
    assert got == sorted((str(u), *s) for u, times in by.items() for s in by_hand(times))
    assert sessions.sessions(spark.createDataFrame([], SCHEMA), HOLD, STEP).count() == 0


def test_a_hold_to_its_last_second(spark):
    rows = [(1, 1, T0), (2, 1, T0 + timedelta(seconds=HOLD, microseconds=999_999)), (3, 1, T0 + timedelta(seconds=2 * HOLD + 1))]
    got = sessions.sessions(spark.createDataFrame(rows, SCHEMA), HOLD, STEP).collect()
    assert sorted((r.requests, r.renewals) for r in got) == [(1, 1), (2, 2)]


def test_a_stream_tells_the_sessions_of_the_table(spark, tmp_path):
    rows, by = requests()
    rows = [r for r in rows if r[1] is not None]
    end = max(r[2] for r in rows) + timedelta(days=3)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    steps = [rows[at : at + 40] for at in range(0, len(rows), 40)] + [[(10_000, 99, end)], [(10_001, 99, end + timedelta(seconds=1))]]
    for part in steps:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = sessions.sessions_stream(spark.readStream.schema(SCHEMA).parquet(src), "10 seconds", HOLD, STEP)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r.user_id, r.first - EPOCH, r.last - EPOCH, r.requests, r.renewals, r.expires - EPOCH) for r in spark.read.parquet(out).collect())
    assert got == sorted((u, *s) for u, times in by.items() if u is not None for s in by_hand(times))


def test_debits_of_a_hot_user_in_small_batches(spark):
    rng = random.Random(3)
    rows = [(k, 1 if k % 3 == 0 else rng.randint(2, 40), Decimal(rng.randint(-90, 40)) / 4) for k in range(3000)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
        got = {r.id: (r.counted, r.balance) for r in stateful.spends(spark.createDataFrame(rows, "id long, user_id long, delta decimal(18,4)").repartition(6)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    has = {}
    for k, user, d in rows:
        fine = d >= 0 or has.get(user, 0) + d >= 0
        has[user] = has.get(user, 0) + (d if fine else 0)
        assert got[k] == (fine, float(has[user]))
    assert {ok for ok, _ in got.values()} == {True, False}
