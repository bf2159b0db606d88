"""Job, artifact, share, session, key, webhook, notification and flag queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuelake.operators import exports as X
from cuelake.operators import flags
from cuelake.operators import jobs as J
from cuelake.plans.registry import query
from cuelake.sources.model import AS_OF
from cuelake.streaming import metrics, stateful

_NOW = f"TIMESTAMP '{AS_OF}'"
_NOW_S = 1706659200


def _top(df, part, order, n):
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(part).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


@query("job_latest_event", "SELECT job_id, max(id) AS id, arg_max(step, id) AS step, arg_max(message, id) AS message, arg_max(data, id) AS data FROM job_events GROUP BY job_id")
def _(v):
    return J.latest_event(v.job_events)


@query(
    "job_timeline",
    "SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY id) AS INTEGER) AS seq, id, step, message, CASE WHEN json_valid(data) AND trim(data) LIKE '{%' THEN data ELSE '{}' END AS data FROM job_events",
)
def _(v):
    return J.timeline(v.job_events)


@query("job_latest_artifact", "SELECT job_id, kind, arg_max(path, (id, path)) AS path FROM artifacts GROUP BY job_id, kind")
def _(v):
    return J.latest_artifacts(v.artifacts)


@query(
    "job_artifact_map",
    "WITH l AS (SELECT job_id, kind, arg_max(path, (id, path)) AS path FROM artifacts GROUP BY job_id, kind) SELECT job_id, string_agg(kind || '=' || path, ';' ORDER BY kind) AS artifacts FROM l GROUP BY job_id",
)
def _(v):
    text = F.array_join(F.transform(F.array_sort(F.map_entries("artifacts")), lambda e: F.concat(e.key, F.lit("="), e.value)), ";")
    return J.artifact_maps(v.artifacts).select("job_id", text.alias("artifacts"))


@query("jobs_newest", "SELECT id, user_id, status, created_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS r FROM jobs) WHERE r <= 20")
def _(v):
    return _top(v.jobs, "user_id", (F.desc("created_at"), F.desc("id")), 20).select("id", "user_id", "status", "created_at")


@query("jobs_page", "SELECT id, user_id, status, created_at FROM jobs WHERE status = 'done' ORDER BY created_at DESC, id DESC LIMIT 20")
def _(v):
    return J.page(v.jobs, 20, status="done").select("id", "user_id", "status", "created_at")


@query(
    "jobs_next_page",
    """
WITH c AS (SELECT created_at, id FROM jobs WHERE status = 'done' ORDER BY created_at DESC, id DESC LIMIT 1 OFFSET 19)
SELECT j.id, j.user_id, j.created_at FROM jobs j, c WHERE status = 'done' AND (j.created_at < c.created_at OR (j.created_at = c.created_at AND j.id < c.id)) ORDER BY j.created_at DESC, j.id DESC LIMIT 20""",
)
def _(v):
    last = J.page(v.jobs, 20, status="done").orderBy("created_at", "id").limit(1).select(F.col("created_at").alias("c_at"), F.col("id").alias("c_id"))
    after = (F.col("created_at") < F.col("c_at")) | ((F.col("created_at") == F.col("c_at")) & (F.col("id") < F.col("c_id")))
    rows = v.jobs.filter("status = 'done'").join(F.broadcast(last), after)  # a frame of one row
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(20).select("id", "user_id", "created_at")


@query("job_cursor", "SELECT id, translate(base64(encode(strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '+00:00|' || CAST(id AS VARCHAR))), '+/', '-_') AS cursor FROM jobs")
def _(v):
    return v.jobs.select("id", J.cursor_of(F.col("created_at"), F.col("id")).alias("cursor"))


@query(
    "jobs_view",
    """
WITH e AS (SELECT job_id, arg_max(step, id) AS step FROM job_events GROUP BY job_id), a AS (SELECT job_id, count(DISTINCT kind) AS kinds FROM artifacts GROUP BY job_id)
SELECT j.id, j.user_id, j.status, coalesce(a.kinds, 0) AS kinds, CASE WHEN j.status IN ('queued', 'running') THEN e.step END AS latest_step
FROM jobs j LEFT JOIN a ON j.id = a.job_id LEFT JOIN e ON j.id = e.job_id""",
)
def _(v):
    return J.jobs_view(v.jobs, v.artifacts, v.job_events).select("id", "user_id", "status", "kinds", "latest_step")


@query("jobs_active_count", "SELECT user_id, count(*) FILTER (WHERE status IN ('queued', 'running')) AS active FROM jobs GROUP BY user_id")
def _(v):
    return v.jobs.groupBy("user_id").agg(F.count_if(F.col("status").isin(*J.ACTIVE)).alias("active"))


@query("jobs_finished_old", f"SELECT id, status, updated_at FROM jobs WHERE status IN ('done', 'failed', 'canceled') AND updated_at < {_NOW} - INTERVAL 30 DAY")
def _(v):
    return J.finished_before(v.jobs, F.expr(_NOW), 30).select("id", "status", "updated_at")


@query(
    "retention_purge",
    f"SELECT a.id, a.job_id FROM artifacts a WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.id = a.job_id AND j.status IN ('done', 'failed', 'canceled') AND j.updated_at < {_NOW} - INTERVAL 30 DAY)",
)
def _(v):
    return J.purge(v.artifacts, J.finished_before(v.jobs, F.expr(_NOW), 30)).select("id", "job_id")


@query("job_options", "SELECT id, coalesce(meta_json LIKE '%\"diarize\":true%', false) AS diarize, coalesce(meta_json LIKE '%\"polish\":true%', false) AS polish, false AS align, false AS words FROM jobs")
def _(v):
    return v.jobs.select("id", J.options(F.col("meta_json")).alias("o")).select("id", "o.*")


@query("shares_jobs", "SELECT s.id, s.job_id, j.status AS job_status, j.type AS job_type, s.expires_at FROM shares s JOIN jobs j ON j.id = s.job_id")
def _(v):
    s, j = v.shares.alias("s"), v.jobs.alias("j")
    return s.join(j, F.col("s.job_id") == F.col("j.id")).select("s.id", "s.job_id", F.col("j.status").alias("job_status"), F.col("j.type").alias("job_type"), "s.expires_at")


@query(
    "sessions_valid",
    f"""
SELECT s.token, s.user_id, u.plan, (s.last_seen_at IS NULL OR {_NOW_S} - CAST(s.last_seen_at AS BIGINT) > 3600) AS renew,
  CASE WHEN s.last_seen_at IS NULL OR {_NOW_S} - CAST(s.last_seen_at AS BIGINT) > 3600 THEN {_NOW_S} + 30 * 86400 ELSE CAST(s.expires_at AS BIGINT) END AS expires_s
FROM sessions s JOIN users u ON u.id = s.user_id WHERE s.expires_at IS NULL OR CAST(s.expires_at AS BIGINT) >= {_NOW_S}""",
)
def _(v):
    return J.session_users(v.sessions, v.users, F.lit(_NOW_S))


@query("sessions_purged", f"SELECT token FROM sessions WHERE CAST(expires_at AS BIGINT) < {_NOW_S}")
def _(v):
    return v.sessions.filter(F.col("expires_at").cast("bigint") < _NOW_S).select("token")


@query("notifications_unread", "SELECT user_id, count(*) FILTER (WHERE read_at IS NULL) AS unread FROM notifications GROUP BY user_id")
def _(v):
    return v.notifications.groupBy("user_id").agg(F.count_if(F.col("read_at").isNull()).alias("unread"))


@query("notifications_page", "SELECT id, user_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS r FROM notifications WHERE read_at IS NULL) WHERE r <= 30")
def _(v):
    return _top(v.notifications.filter("read_at IS NULL"), "user_id", (F.desc("id"),), 30).select("id", "user_id", "kind")


@query("payments_page", "SELECT id, user_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS r FROM payments) WHERE r <= 100")
def _(v):
    return _top(v.payments, "user_id", (F.desc("created_at"), F.desc("id")), 100).select("id", "user_id", "created_at")


@query("shares_page", "SELECT id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS r FROM shares) WHERE r <= 50")
def _(v):
    return _top(v.shares, "user_id", (F.desc("created_at"), F.desc("id")), 50).select("id", "user_id")


@query("webhooks_for_event", "SELECT id, user_id FROM webhooks WHERE active = 1 AND list_contains(list_transform(string_split(events, ','), lambda x: trim(x)), 'failed')")
def _(v):
    return J.subscribed(v.webhooks, "failed").select("id", "user_id")


@query(
    "webhook_deliveries",
    "SELECT e.id AS event_id, w.id AS webhook_id FROM job_events e JOIN jobs j ON j.id = e.job_id JOIN webhooks w ON w.user_id = j.user_id WHERE j.status = 'done' AND w.active = 1 AND list_contains(list_transform(string_split(w.events, ','), lambda x: trim(x)), 'done')",
)
def _(v):
    e, j, w = v.job_events.alias("e"), v.jobs.filter("status = 'done'").alias("j"), J.subscribed(v.webhooks, "done").alias("w")
    rows = e.join(j, F.col("e.job_id") == F.col("j.id")).join(w, F.col("w.user_id") == F.col("j.user_id"))
    return rows.select(F.col("e.id").alias("event_id"), F.col("w.id").alias("webhook_id"))


#: The driver's hooks belong to users without jobs; dealt to other users they get deliveries.
@query(
    "webhook_deliveries_planted",
    "SELECT e.id AS event_id, w.id AS webhook_id FROM job_events e JOIN jobs j ON j.id = e.job_id JOIN webhooks w ON w.id * 7 % 1500 = j.user_id WHERE j.status = 'done' AND w.active = 1 AND list_contains(list_transform(string_split(w.events, ','), lambda x: trim(x)), 'done')",
)
def _(v):
    hooks = J.subscribed(v.webhooks.withColumn("user_id", F.col("id") * 7 % 1500), "done").select(F.col("id").alias("webhook_id"), "user_id")
    done = v.jobs.filter("status = 'done'").select(F.col("id").alias("job_id"), "user_id").join(hooks, "user_id")
    return v.job_events.join(done, "job_id").select(F.col("id").alias("event_id"), "webhook_id")


@query("api_keys_hashed", "SELECT id, sha256(raw_key) AS key_hash, substr(raw_key, 1, 14) AS key_prefix FROM api_keys")
def _(v):
    return v.api_keys.select("id", F.sha2("raw_key", 256).alias("key_hash"), F.substring("raw_key", 1, 14).alias("key_prefix"))


@query("api_keys_verified", "SELECT s_suppkey AS asked, k.id FROM supplier JOIN api_keys k ON sha256(s_name) = sha256(k.raw_key) WHERE k.revoked_at IS NULL")
def _(v):
    keys = v.api_keys.filter("revoked_at IS NULL").select("id", F.sha2("raw_key", 256).alias("key_hash"))
    asked = v.supplier.select(F.col("s_suppkey").alias("asked"), F.sha2("s_name", 256).alias("key_hash"))
    return asked.join(keys, "key_hash").select("asked", "id")


@query("glossary_latest", "SELECT user_id, src_term, arg_max(tgt_term, (id, tgt_term)) AS tgt_term FROM glossary GROUP BY user_id, src_term")
def _(v):
    return J.latest_terms(v.glossary)


@query("users_by_contact", "SELECT id, contact FROM users WHERE contact = lower('Customer#000000042')")
def _(v):
    return v.users.filter(F.col("contact") == F.lower(F.lit("Customer#000000042"))).select("id", "contact")


_FLAGS = "(VALUES ('new_pricing', true, 'pro', 100), ('beta_editor', true, 'free', 40), ('dark_mode', false, 'free', 100), ('studio_mix', true, 'studio', 10))"


@query(
    "flags_enabled",
    f"""
WITH f AS (SELECT * FROM {_FLAGS} AS t(flag, enabled, min_plan, pct)), h AS (SELECT f.*, u.id AS user_id, u.plan, md5(flag || ':' || CAST(u.id AS VARCHAR)) AS d FROM f CROSS JOIN users u)
SELECT flag, user_id, enabled AND CASE plan WHEN 'free' THEN 0 WHEN 'pro' THEN 1 ELSE 2 END >= CASE min_plan WHEN 'free' THEN 0 WHEN 'pro' THEN 1 ELSE 2 END
  AND (pct >= 100 OR (pct > 0 AND list_reduce(list_prepend(0, list_transform(range(1, 33), lambda i: strpos('0123456789abcdef', substr(d, i, 1)) - 1)), lambda a, x: (a * 16 + x) % 100) < pct)) AS enabled
FROM h""",
)
def _(v):
    flags = v.spark.sql(f"SELECT * FROM {_FLAGS} AS t(flag, enabled, min_plan, pct)")
    rows = v.users.crossJoin(F.broadcast(flags))  # a handful of flags
    on = J.flag_enabled(F.col("enabled"), F.col("min_plan"), F.col("pct"), F.col("flag"), F.col("id"), F.col("plan"))
    return rows.select("flag", F.col("id").alias("user_id"), on.alias("enabled"))


@query("endpoint_limits", """
WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '/api/auth/x' WHEN 1 THEN '/api/jobs/' || page_id WHEN 2 THEN '/api/v1/ling/align' WHEN 3 THEN '/api/v1/ling/x' WHEN 4 THEN '/api/account/me/' || page_id ELSE '/' END AS path FROM pages)
SELECT page_id, CASE WHEN path LIKE '/api/auth/%' THEN 20 WHEN path LIKE '/api/jobs%' THEN 60 WHEN path LIKE '/api/v1/ling/align%' THEN 12 WHEN path LIKE '/api/v1/ling%' THEN 60 ELSE 300 END AS max_hits,
  CASE WHEN path LIKE '/api/auth/%' THEN '/api/auth/' WHEN path LIKE '/api/jobs%' THEN '/api/jobs' WHEN path LIKE '/api/v1/ling/align%' THEN '/api/v1/ling/align' WHEN path LIKE '/api/v1/ling%' THEN '/api/v1/ling' WHEN path = '/' THEN '/' ELSE '/api/account' END AS rate_class FROM p""")
def _(v):
    path = F.expr("CASE page_id % 6 WHEN 0 THEN '/api/auth/x' WHEN 1 THEN '/api/jobs/' || page_id WHEN 2 THEN '/api/v1/ling/align' WHEN 3 THEN '/api/v1/ling/x' WHEN 4 THEN '/api/account/me/' || page_id ELSE '/' END")
    return v.pages.select("page_id", J.endpoint_limit(path).alias("max_hits"), J.rate_class(path).alias("rate_class"))


@query(
    "throttle_window",
    "SELECT event_id AS id, user_id AS key, count(*) OVER w AS in_window, count(*) OVER w > 8 AS over FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 899999999 PRECEDING AND CURRENT ROW)",
)
def _(v):
    hits = v.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"))
    return J.throttled(hits, 900, 8)


@query(
    "account_export",
    """
WITH b AS (SELECT user_id, sum(delta) AS balance FROM ledger GROUP BY user_id), j AS (SELECT user_id, count(*) AS n FROM jobs GROUP BY user_id),
p AS (SELECT user_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS r FROM payments) WHERE r <= 100 GROUP BY user_id)
SELECT u.id, u.name, CAST(coalesce(b.balance, 0) AS DOUBLE) AS balance, coalesce(j.n, 0) AS jobs, coalesce(p.ids, '') AS payments FROM users u LEFT JOIN b ON b.user_id = u.id LEFT JOIN j ON j.user_id = u.id LEFT JOIN p ON p.user_id = u.id""",
)
def _(v):
    balance = v.ledger.groupBy("user_id").agg(F.sum("delta").alias("balance"))
    jobs = v.jobs.groupBy("user_id").agg(F.count("*").alias("jobs"))
    paid = _top(v.payments, "user_id", (F.desc("created_at"), F.desc("id")), 100)
    paid = paid.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("payments"))
    u = v.users.select(F.col("id").alias("user_id"), "name")
    out = u.join(balance, "user_id", "left").join(jobs, "user_id", "left").join(paid, "user_id", "left")
    return out.select(
        F.col("user_id").alias("id"), "name", F.coalesce("balance", F.lit(0)).cast("double").alias("balance"), F.coalesce("jobs", F.lit(0)).alias("jobs"), F.coalesce("payments", F.lit("")).alias("payments")
    )


_AT = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


@query(
    "account_export_json",
    f"""
WITH j AS (SELECT user_id, list({{'id': id, 'type': type, 'status': status, 'minutes': round_even(CAST(minutes AS DOUBLE) * 100, 0) / 100, 'created_at': {_AT.format('created_at')}}} ORDER BY created_at DESC, id DESC) AS jobs FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS r FROM jobs) WHERE r <= 9999 GROUP BY user_id),
g AS (SELECT user_id, list({{'src': src_term, 'tgt': tgt_term}} ORDER BY id DESC) AS glossary FROM glossary GROUP BY user_id),
p AS (SELECT user_id, list({{'id': id, 'amount_minor': amount_minor, 'currency': currency, 'status': status, 'created_at': {_AT.format('created_at')}}} ORDER BY created_at DESC, id DESC) AS payments FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS r FROM payments) WHERE r <= 3 GROUP BY user_id),
n AS (SELECT user_id, list({{'kind': kind, 'read_at': {_AT.format('read_at')}, 'created_at': {_AT.format('created_at')}}} ORDER BY id DESC) AS notifications FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS r FROM notifications) WHERE r <= 9999 GROUP BY user_id),
s AS (SELECT user_id, list({{'id': id, 'job_id': job_id, 'expires_at': {_AT.format('expires_at')}}} ORDER BY created_at DESC, id DESC) AS shares FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS r FROM shares) WHERE r <= 4 GROUP BY user_id),
b AS (SELECT user_id, round(CAST(sum(delta) AS DOUBLE), 4) AS balance FROM ledger GROUP BY user_id)
SELECT u.id AS user_id, CAST(to_json({{'exported_at': '{AS_OF}', 'format_version': 1, 'user': {{'name': u.name, 'contact': u.contact, 'plan': u.plan, 'created_at': strftime(u.created_on, '%Y-%m-%d')}}, 'balance_minutes': coalesce(b.balance, 0.0::DOUBLE),
  'jobs': coalesce(j.jobs, []), 'glossary': coalesce(g.glossary, []), 'payments': coalesce(p.payments, []), 'notifications': coalesce(n.notifications, []), 'shares': coalesce(s.shares, [])}}) AS VARCHAR) AS body
FROM users u LEFT JOIN j ON j.user_id = u.id LEFT JOIN g ON g.user_id = u.id LEFT JOIN p ON p.user_id = u.id LEFT JOIN n ON n.user_id = u.id LEFT JOIN s ON s.user_id = u.id LEFT JOIN b ON b.user_id = u.id""",
)
def _(v):
    """With lower caps for payments and shares than an account's own, so that users of the check reach them."""
    c, at = F.col, lambda name: X.moment(F.col(name))
    newest = ["created_at", "id"]
    lists = [
        X.listed(v.jobs, "user_id", "jobs", newest, {"id": c("id"), "type": c("type"), "status": c("status"), "minutes": F.rint(c("minutes").cast("double") * 100) / 100, "created_at": at("created_at")}, X.MOST["jobs"]),
        X.listed(v.glossary, "user_id", "glossary", ["id"], {"src": c("src_term"), "tgt": c("tgt_term")}),
        X.listed(v.payments, "user_id", "payments", newest, {"id": c("id"), "amount_minor": c("amount_minor"), "currency": c("currency"), "status": c("status"), "created_at": at("created_at")}, 3),
        X.listed(v.notifications, "user_id", "notifications", ["id"], {"kind": c("kind"), "read_at": at("read_at"), "created_at": at("created_at")}, X.MOST["notifications"]),
        X.listed(v.shares, "user_id", "shares", newest, {"id": c("id"), "job_id": c("job_id"), "expires_at": at("expires_at")}, 4),
    ]
    users = v.users.withColumn("created_at", c("created_on").cast("string"))
    return X.exported(users, v.ledger.groupBy("user_id").agg(F.sum("delta").alias("balance")), lists, AS_OF)


@query(
    "metrics_text",
    """
SELECT 'jobs_active ' || (SELECT count(*) FROM jobs WHERE status IN ('queued', 'running')) || chr(10) || 'jobs_total ' || (SELECT count(*) FROM jobs) || chr(10) || 'sessions ' || (SELECT count(*) FROM sessions) AS body""",
)
def _(v):
    j = v.jobs.agg(F.count_if(F.col("status").isin(*J.ACTIVE)).alias("a"), F.count("*").alias("t")).crossJoin(v.sessions.agg(F.count("*").alias("s")))
    return j.select(F.format_string("jobs_active %d\njobs_total %d\nsessions %d", "a", "t", "s").alias("body"))


@query(
    "metrics_lines",
    """
WITH f AS (SELECT row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 2 AS delivered FROM events),
l AS (SELECT unnest([
  'cuelake_active_jobs ' || (SELECT count(*) FROM jobs WHERE status IN ('queued', 'running')), 'cuelake_total_jobs ' || (SELECT count(*) FROM jobs), 'cuelake_active_sessions ' || (SELECT count(*) FROM sessions),
  'cuelake_frames_total{result="published"} ' || (SELECT count(*) FROM f WHERE delivered), 'cuelake_frames_total{result="dropped"} ' || (SELECT count(*) FROM f WHERE NOT delivered)]) AS line)
SELECT line FROM l""",
)
def _(v):
    """What collectors read, without help and type: tables are counted by aggregates, frames by what is observed while they are delivered."""
    frames = stateful.delivered(v.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at")), "1 day", 2)
    passing, seen = metrics.observed(frames, "frames", {"published": F.col("delivered"), "dropped": ~F.col("delivered")})
    passing.write.format("noop").mode("overwrite").save()
    n = v.jobs.agg(F.count_if(F.col("status").isin(*J.ACTIVE)).alias("a"), F.count("*").alias("t")).first()
    told = [
        *metrics.lines("gauge", "cuelake_active_jobs", "Jobs queued or running.", {"": n["a"]}),
        *metrics.lines("counter", "cuelake_total_jobs", "Jobs so far.", {"": n["t"]}),
        *metrics.lines("gauge", "cuelake_active_sessions", "Sessions.", {"": v.sessions.count()}),
        *metrics.lines("counter", "cuelake_frames_total", "Frames by outcome.", {f'{{result="{k}"}}': seen.get[k] for k in ("published", "dropped")}),
    ]
    return v.spark.createDataFrame([(x,) for x in told if x[0] != "#"], "line string")


_FILES = """
SELECT id, CASE id % 9 WHEN 0 THEN '{"webhook_out":{"enabled":false,"min_plan":"studio","pct":0},"beta":{"enabled":true}}' WHEN 1 THEN 'no json' WHEN 2 THEN '[1,{"job_sharing":{}}]'
  WHEN 3 THEN '{"job_sharing":5,"api_keys":{"enabled":false,"min_plan":"pro","pct":' || CAST(id % 101 AS STRING) || '}}' WHEN 4 THEN NULL
  WHEN 5 THEN '{"batch_jobs":{"enabled":false,"min_plan":"studio","pct":' || CAST(id % 2 * 10 AS STRING) || '},"webhook_out":"on"}' WHEN 6 THEN '{}' WHEN 7 THEN '"text"'
  ELSE '{"batch_jobs":{"enabled":false,"extra":1,"min_plan":"studio","pct":10},"webhook_out":{"pct":0,"enabled":false,"min_plan":"studio"}}' END AS text
FROM users"""
_DEFAULT = '{"enabled":true,"min_plan":"free","pct":100}'


@query(
    "flags_reconciled",
    f"""
WITH files AS ({_FILES.strip()}),
j AS (SELECT id, CASE WHEN json_valid(text) AND json_type(CAST(text AS JSON)) = 'OBJECT' THEN CAST(text AS JSON) ELSE CAST('{{}}' AS JSON) END AS j FROM files),
n AS (SELECT id, j, unnest(list_distinct(list_concat(json_keys(j), ['job_sharing', 'api_keys', 'webhook_out', 'batch_jobs', 'uzbek_language_engine']))) AS flag FROM j),
v AS (SELECT id, flag, flag IN ('job_sharing', 'api_keys', 'webhook_out', 'batch_jobs', 'uzbek_language_engine') AS known, json_extract(j, '$.' || flag) AS value FROM n),
o AS (SELECT id, flag, value, CASE WHEN value IS NULL THEN 'default' WHEN known AND json_type(value) <> 'OBJECT' THEN 'coerced'
  WHEN len(json_keys(value)) = 3 AND NOT CAST(value->>'enabled' AS BOOLEAN) AND value->>'min_plan' = 'studio' AND (flag = 'webhook_out' AND value->>'pct' = '0' OR flag = 'batch_jobs' AND value->>'pct' = '10') THEN 'upgraded' ELSE 'kept' END AS origin FROM v)
SELECT id, flag, CASE WHEN origin = 'kept' THEN CAST(value AS VARCHAR) ELSE '{_DEFAULT}' END AS value, origin FROM o""",
)
def _(v):
    text = _FILES.split("SELECT id, ", 1)[1].rsplit("FROM users", 1)[0]
    files = v.users.selectExpr("id", text)
    return flags.reconciled(files, "id", "text")


@query("users_deleted", "SELECT l.id FROM ledger l WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.id = l.user_id AND u.plan = 'studio')")
def _(v):
    gone = v.users.filter("plan = 'studio'")
    return J.purge(v.ledger, gone, "user_id").select("id")


@query(
    "job_transitions",
    """
WITH s AS (SELECT id, job_id, step, lag(step) OVER (PARTITION BY job_id ORDER BY id) AS before FROM job_events)
SELECT coalesce(before, '-') AS before, step, count(*) AS n FROM s GROUP BY ALL""",
)
def _(v):
    before = F.lag("step").over(Window.partitionBy("job_id").orderBy("id"))
    return v.job_events.select("step", F.coalesce(before, F.lit("-")).alias("before")).groupBy("before", "step").agg(F.count("*").alias("n"))


@query(
    "stale_jobs_recovered",
    "SELECT id, CASE WHEN status IN ('queued', 'running') THEN 'failed' ELSE status END AS status FROM jobs",
)
def _(v):
    return v.jobs.select("id", F.when(F.col("status").isin(*J.ACTIVE), "failed").otherwise(F.col("status")).alias("status"))


@query("notifications_read_once", "SELECT id, coalesce(read_at, TIMESTAMP '2024-01-31 00:00:00') AS read_at FROM notifications")
def _(v):
    return v.notifications.select("id", F.coalesce("read_at", F.expr(_NOW).cast("timestamp_ntz")).alias("read_at"))


@query(
    "jobs_admission",
    """
WITH a AS (SELECT user_id, count(*) FILTER (WHERE status IN ('queued', 'running')) AS active FROM jobs GROUP BY user_id), b AS (SELECT user_id, sum(delta) AS balance FROM ledger GROUP BY user_id)
SELECT j.id, CASE WHEN a.active > 5 THEN 'too_many_active' WHEN round(j.minutes, 2) < 0.1 THEN 'too_short' WHEN j.minutes > 30 THEN 'too_long' WHEN coalesce(b.balance, 0) < j.minutes THEN 'no_minutes' ELSE 'ok' END AS code
FROM jobs j JOIN a ON a.user_id = j.user_id LEFT JOIN b ON b.user_id = j.user_id""",
)
def _(v):
    a = v.jobs.groupBy("user_id").agg(F.count_if(F.col("status").isin(*J.ACTIVE)).alias("active"))
    b = v.ledger.groupBy("user_id").agg(F.sum("delta").alias("balance"))
    rows = v.jobs.join(a, "user_id").join(b, "user_id", "left")
    code = (
        F.when(F.col("active") > 5, "too_many_active")
        .when(F.round("minutes", 2) < 0.1, "too_short")
        .when(F.col("minutes") > 30, "too_long")
        .when(F.coalesce("balance", F.lit(0)) < F.col("minutes"), "no_minutes")
        .otherwise("ok")
    )
    return rows.select("id", code.alias("code"))
