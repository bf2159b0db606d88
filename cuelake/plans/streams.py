"""Sequential folds over events, in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.plans.registry import query
from cuelake.streaming import stateful as S


def _hits(v):
    return v.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "error").alias("failed"))


_TIMED = "n AS (SELECT event_id AS id, user_id AS key, epoch_us(ts) / 1000000.0::DOUBLE AS t, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"


@query(
    "hits_admitted",
    f"""
WITH RECURSIVE {_TIMED},
s AS (SELECT id, key, k, true AS admitted, [t] AS kept FROM n WHERE k = 1
  UNION ALL SELECT n.id, n.key, n.k, len(x.live) < 2, CASE WHEN len(x.live) < 2 THEN list_append(x.live, n.t) ELSE x.live END
  FROM s JOIN n ON n.key = s.key AND n.k = s.k + 1, LATERAL (SELECT list_filter(s.kept, lambda a: a > n.t - 86400) AS live) AS x)
SELECT id, key, admitted FROM s""",
)
def _(v):
    return S.admitted(_hits(v), 86400.0, 2)


@query(
    "breaker_states",
    f"""
WITH RECURSIVE {_TIMED},
s AS (SELECT id, key, k, 'closed' AS state, CAST(failed AS INTEGER) AS run, NULL::DOUBLE AS since FROM n WHERE k = 1
  UNION ALL SELECT id, key, k, state, CASE WHEN state = 'open' THEN run WHEN failed THEN run + 1 ELSE 0 END,
    CASE WHEN state = 'open' THEN since WHEN NOT failed THEN NULL WHEN state = 'half_open' OR run + 1 >= 5 THEN t ELSE since END
  FROM (SELECT n.id, n.key, n.k, n.t, n.failed, s.run, s.since, CASE WHEN s.since IS NULL THEN 'closed' WHEN n.t - s.since < 60 THEN 'open' ELSE 'half_open' END AS state FROM s JOIN n ON n.key = s.key AND n.k = s.k + 1))
SELECT id, key, state FROM s""",
)
def _(v):
    return S.breaker(_hits(v))


@query(
    "debits_admitted",
    """
WITH RECURSIVE n AS (SELECT id, user_id, CAST(delta * 10000 AS BIGINT) AS d, row_number() OVER (PARTITION BY user_id ORDER BY id) AS k FROM ledger),
s AS (SELECT id, user_id, k, d >= 0 AS counted, greatest(d, 0) AS balance FROM n WHERE k = 1
  UNION ALL SELECT n.id, n.user_id, n.k, n.d >= 0 OR s.balance + n.d >= 0, CASE WHEN n.d >= 0 OR s.balance + n.d >= 0 THEN s.balance + n.d ELSE s.balance END FROM n JOIN s ON n.user_id = s.user_id AND n.k = s.k + 1)
SELECT id, user_id, counted, balance / 10000 AS balance FROM s""",
)
def _(v):
    return S.spends(v.ledger)


@query(
    "sessions_kept",
    """
WITH RECURSIVE n AS (SELECT user_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch_us(ts) / 1000000), event_id) AS k FROM events),
s AS (SELECT user_id, k, t, t AS renewed, 1 AS renews, 1 AS session FROM n WHERE k = 1
  UNION ALL SELECT n.user_id, n.k, n.t, CASE WHEN s.renewed + 172800 < n.t OR n.t - s.renewed > 86400 THEN n.t ELSE s.renewed END,
    CASE WHEN s.renewed + 172800 < n.t OR n.t - s.renewed > 86400 THEN 1 ELSE 0 END, s.session + CASE WHEN s.renewed + 172800 < n.t THEN 1 ELSE 0 END
  FROM s JOIN n ON n.user_id = s.user_id AND n.k = s.k + 1)
SELECT user_id, min(t) AS first, max(t) AS last, count(*) AS requests, CAST(sum(renews) AS BIGINT) AS renewals, max(renewed) + 172800 AS expires FROM s GROUP BY user_id, session""",
)
def _(v):
    from cuelake.operators import sessions

    return sessions.sessions(_hits(v).select("id", F.col("key").alias("user_id"), "at"), hold=2 * 86400, step=86400)


@query("events_per_day", "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL")
def _(v):
    at = v.events.withColumn("at", F.col("ts").cast("timestamp"))
    rows = S.counted_per_window(at, "at", "1 day", "1 day", "event_type")
    return rows.select("event_type", F.to_date("window.start").alias("day"), "n")


@query("steps_progress", "SELECT event_id AS id, CASE event_type WHEN 'signup' THEN 5 WHEN 'view' THEN 40 WHEN 'purchase' THEN 100 ELSE 30 END AS pct FROM events")
def _(v):
    pct = F.create_map(F.lit("signup"), F.lit(5), F.lit("view"), F.lit(40), F.lit("purchase"), F.lit(100))
    return v.events.select(F.col("event_id").alias("id"), F.coalesce(pct[F.col("event_type")], F.lit(30)).alias("pct"))


@query(
    "frames_delivered",
    "SELECT event_id AS id, user_id AS key, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 2 AS delivered FROM events",
)
def _(v):
    return S.delivered(_hits(v), "1 day", 2)


@query(
    "events_fanned_out",
    """
WITH e AS (SELECT event_id AS id, user_id AS job_id, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE event_type END AS step FROM events),
r AS (SELECT e.*, j.user_id FROM e JOIN jobs j ON j.id = e.job_id),
h AS (SELECT CASE id % 2 WHEN 0 THEN 'done, failed' ELSE 'failed' END AS names, id, id * 7 % 1500 AS user_id FROM webhooks)
SELECT id, user_id, 'frame' AS kind, CASE step WHEN 'done' THEN '100' WHEN 'failed' THEN '100' ELSE '30' END AS target FROM r
UNION ALL SELECT id, user_id, 'notice', 'job_' || step FROM r WHERE step IN ('done', 'failed')
UNION ALL SELECT r.id, r.user_id, 'call', CAST(h.id AS VARCHAR) FROM r JOIN h ON h.user_id = r.user_id AND contains(h.names, r.step) WHERE step IN ('done', 'failed')""",
)
def _(v):
    from cuelake.functions.checks import progress

    step = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type"))
    events = v.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), step.alias("step"))
    hooks = v.webhooks.select("id", (F.col("id") * 7 % 1500).alias("user_id"), F.when(F.col("id") % 2 == 0, "done, failed").otherwise("failed").alias("events"))
    return S.fanned_out(events, v.jobs, hooks, progress(F.col("step")))


@query("tickets_used_once", "SELECT user_id, event_type, min(event_id) AS id FROM events GROUP BY user_id, event_type")
def _(v):
    good = v.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("user"), F.col("event_type").alias("at"), F.lit(None).cast("string").alias("code"))
    return S.used_once(good).filter("fresh").select(F.col("user").alias("user_id"), F.col("at").alias("event_type"), "id")


@query(
    "texts_chosen",
    """
WITH m AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '.srt' ELSE '.mp3' END AS ext FROM documents)
SELECT '/in/' || doc_id || ext AS path, CASE WHEN ext = '.srt' THEN 'own' WHEN doc_id % 2 = 0 THEN 'sidecar' ELSE 'stand_in' END AS source FROM m""",
)
def _(v):
    from cuelake.sources import choice

    name = F.concat(F.lit("/in/"), F.col("doc_id").cast("string"))
    media = v.documents.select(F.concat(name, F.when(F.col("doc_id") % 3 == 0, ".srt").otherwise(".mp3")).alias("path"), F.when(F.col("doc_id") % 3 == 0, F.col("text")).alias("content"))
    texts = v.documents.filter("doc_id % 2 = 0").select(F.concat(name, F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    return choice.chosen(media, texts).select("path", "source")


@query("texts_invented", "SELECT '/in/' || doc_id || '.mp3' AS path FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 2 <> 0")
def _(v):
    from cuelake.sources import choice

    name = F.concat(F.lit("/in/"), F.col("doc_id").cast("string"))
    media = v.documents.select(F.concat(name, F.when(F.col("doc_id") % 3 == 0, ".srt").otherwise(".mp3")).alias("path"))
    return choice.invented(media, v.documents.filter("doc_id % 2 = 0").select(F.concat(name, F.lit(".txt")).alias("path")))


@query("stand_in_segments", "SELECT '/in/' || doc_id AS path, CAST(k AS INTEGER) AS pos, k * 4.0::DOUBLE AS \"start\", k * 4.0::DOUBLE + 4 AS \"end\" FROM (SELECT doc_id, unnest([0, 1]) AS k FROM documents)")
def _(v):
    from cuelake.sources import choice

    return choice.stand_in(v.documents.select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string")).alias("path"))).drop("text")


@query("recogniser_dialects", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'whispercpp' WHEN 2 THEN 'whispercpp' ELSE 'openai' END AS dialect FROM pages")
def _(v):
    from cuelake.sources import choice

    k = F.col("page_id") % 4
    asked = F.when(k == 0, "openai").otherwise("auto")
    return v.pages.select("page_id", choice.dialect(asked, F.when(k == 1, "/usr/bin/Whisper-CLI").otherwise("/opt/asr"), F.when(k == 2, "ggml.BIN")).alias("dialect"))
