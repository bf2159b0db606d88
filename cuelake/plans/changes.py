"""Queries over append-only change logs: what holds now."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.operators import changes as C
from cuelake.plans.registry import query

_OPS = "CASE step WHEN 'signup' THEN 'claim' WHEN 'purchase' THEN 'finish' WHEN 'view' THEN 'fail' WHEN 'click' THEN 'cancel' ELSE 'retry' END"
_MACHINE = """list_reduce(list_prepend({'s': 'queued', 'n': 0}, list({'s': op, 'n': 0} ORDER BY id)), lambda a, e: CASE
  WHEN a.s = 'queued' AND e.s = 'claim' THEN {'s': 'running', 'n': a.n + 1} WHEN a.s = 'running' AND e.s = 'finish' THEN {'s': 'done', 'n': a.n + 1}
  WHEN a.s = 'running' AND e.s = 'fail' THEN {'s': 'failed', 'n': a.n + 1} WHEN a.s = 'queued' AND e.s = 'cancel' THEN {'s': 'canceled', 'n': a.n + 1}
  WHEN a.s IN ('failed', 'canceled') AND e.s = 'retry' THEN {'s': 'queued', 'n': a.n + 1} ELSE a END)"""


@query(
    "job_lifecycles",
    f"WITH o AS (SELECT job_id, id, {_OPS} AS op FROM job_events), r AS (SELECT job_id, {_MACHINE} AS s FROM o GROUP BY job_id) SELECT job_id, s.s AS status, CAST(s.n AS BIGINT) AS taken FROM r",
)
def _(v):
    ops = v.job_events.select("job_id", "id", F.expr(_OPS).alias("op"))
    return C.states(ops, "job_id", "id", "op", C.JOB_MACHINE, C.JOB_STATES, "queued")


@query(
    "jobs_patched",
    """
SELECT job_id, arg_max(message, id) FILTER (WHERE step = 'view') AS message, arg_max(id % 100, id) FILTER (WHERE step = 'purchase') AS progress FROM job_events GROUP BY job_id""",
)
def _(v):
    patches = v.job_events.select("job_id", "id", F.expr("CASE WHEN step = 'view' THEN message END").alias("message"), F.expr("CASE WHEN step = 'purchase' THEN id % 100 END").alias("progress"))
    return C.patched(patches, "job_id", "id", ["message", "progress"])


_GLOSSARY_OPS = "CASE id % 23 WHEN 9 THEN 'delete' WHEN 8 THEN 'clear' ELSE 'upsert' END"


@query(
    "glossary_current",
    f"""
WITH o AS (SELECT *, {_GLOSSARY_OPS} AS op FROM glossary), c AS (SELECT user_id, max(id) AS at FROM o WHERE op = 'clear' GROUP BY user_id),
l AS (SELECT user_id, src_term, arg_max(op, id) AS op, arg_max(tgt_term, id) AS tgt_term, max(id) AS at FROM o WHERE op <> 'clear' GROUP BY user_id, src_term)
SELECT l.user_id, l.src_term, l.tgt_term FROM l LEFT JOIN c ON c.user_id = l.user_id WHERE l.op = 'upsert' AND (c.at IS NULL OR l.at > c.at)""",
)
def _(v):
    changes = v.glossary.withColumn("op", F.expr(_GLOSSARY_OPS))
    return C.cleared(changes, ["user_id", "src_term"], "user_id", "id").select("user_id", "src_term", "tgt_term")


@query(
    "sessions_unrevoked",
    "SELECT s.token FROM sessions s WHERE NOT EXISTS (SELECT 1 FROM job_events e WHERE e.step = 'error' AND 't' || e.job_id = s.token) AND NOT EXISTS (SELECT 1 FROM job_events e WHERE e.step = 'signup' AND e.job_id = s.user_id AND e.id % 5 = 0)",
)
def _(v):
    one = v.job_events.filter("step = 'error'").select(F.concat(F.lit("t"), F.col("job_id").cast("string")).alias("token"))
    every = v.job_events.filter("step = 'signup' AND id % 5 = 0").select(F.col("job_id").alias("user_id"))
    return C.without(C.without(v.sessions, one, ["token"]), every, ["user_id"]).select("token")


@query("users_created", "SELECT 'c' || (job_id % 40) AS contact, min(id) AS taken, count(*) - 1 AS refused FROM job_events WHERE step = 'signup' AND job_id % 9 <> 0 GROUP BY 1 UNION ALL SELECT NULL, id, 0 FROM job_events WHERE step = 'signup' AND job_id % 9 = 0")
def _(v):
    asked = v.job_events.filter("step = 'signup'").select("id", F.expr("CASE WHEN job_id % 9 <> 0 THEN 'c' || CAST(job_id % 40 AS STRING) END").alias("contact"))
    return C.first_wins(asked, ["contact"], "id")


@query("payments_created", "SELECT external_id, min(id) AS taken, count(*) - 1 AS refused FROM payments GROUP BY external_id")
def _(v):
    return C.first_wins(v.payments, ["external_id"], "id")


@query("onboarding_seen", "SELECT u.id, s.seen FROM users u LEFT JOIN (SELECT user_id, min(epoch_us(created_at)) AS seen FROM notifications WHERE kind = 'view' GROUP BY user_id) s ON s.user_id = u.id")
def _(v):
    seen = C.set_once(v.notifications.filter("kind = 'view'").select("user_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("seen")), ["user_id"], "seen")
    return v.users.select("id").join(seen, F.col("id") == F.col("user_id"), "left").select("id", "seen")


@query(
    "api_keys_current",
    "SELECT k.id, count(r.id) > 0 AS revoked FROM api_keys k LEFT JOIN job_events r ON r.step = 'error' AND r.id % 50 = k.id AND r.job_id % 25 = k.user_id GROUP BY k.id",
)
def _(v):
    asked = v.job_events.filter("step = 'error'").select((F.col("id") % 50).alias("id"), (F.col("job_id") % 25).alias("user_id"), F.col("id").alias("at"))
    first = C.set_once(asked, ["id", "user_id"], "at")  # an owner revokes only keys of their own
    return v.api_keys.join(first, ["id", "user_id"], "left").select("id", F.col("at").isNotNull().alias("revoked"))


@query(
    "shares_open",
    "SELECT s.id, count(e.id) AS downloads, count(e.id) >= 3 AS spent, epoch_us(s.created_at) + 72 * 3600000000 AS expires FROM shares s LEFT JOIN job_events e ON e.step = 'click' AND e.job_id = s.id GROUP BY s.id, s.created_at",
)
def _(v):
    many = v.job_events.filter("step = 'click'").groupBy(F.col("job_id").alias("share")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    expires = F.unix_micros(F.col("created_at").cast("timestamp") + F.expr("INTERVAL 72 HOUR"))
    return v.shares.join(many, F.col("id") == F.col("share"), "left").select("id", n.alias("downloads"), (n >= 3).alias("spent"), expires.alias("expires"))


@query("webhooks_current", "SELECT w.id, w.user_id FROM webhooks w WHERE NOT EXISTS (SELECT 1 FROM job_events e WHERE e.step = 'error' AND e.id % 60 = w.id AND e.job_id % 25 = w.user_id)")
def _(v):
    gone = v.job_events.filter("step = 'error'").select((F.col("id") % 60).alias("id"), (F.col("job_id") % 25).cast("int").alias("user_id"))
    return C.without(v.webhooks, gone, ["id", "user_id"]).select("id", "user_id")


_FLAG_LOG = "SELECT 'f' || CAST(job_id % 30 AS STRING) AS flag, id, CASE WHEN id % 4 = 0 THEN 'delete' ELSE 'set' END AS op, id % 101 AS pct FROM job_events"


@query("flags_current", f"WITH o AS ({_FLAG_LOG.replace('STRING', 'VARCHAR')}) SELECT flag, arg_max(pct, id) AS pct FROM o GROUP BY flag HAVING arg_max(op, id) = 'set'")
def _(v):
    log = v.job_events.select(F.expr("'f' || CAST(job_id % 30 AS STRING)").alias("flag"), "id", F.expr("CASE WHEN id % 4 = 0 THEN 'delete' ELSE 'set' END").alias("op"), (F.col("id") % 101).alias("pct"))
    return C.last_wins(log, ["flag"], "id")


@query("audit_rows", """SELECT id, 'job.' || status AS action, user_id AS actor, '{"type":"' || type || '","id":' || id || '}' AS meta FROM jobs WHERE status IN ('failed', 'canceled')""")
def _(v):
    meta = F.to_json(F.struct("type", "id"))
    return v.jobs.filter("status IN ('failed', 'canceled')").select("id", F.concat(F.lit("job."), F.col("status")).alias("action"), F.col("user_id").alias("actor"), meta.alias("meta"))


@query(
    "jobs_retried",
    """
WITH a AS (SELECT r.id, r.job_id, j.user_id, j.status, j.minutes FROM artifacts r JOIN jobs j ON j.id = r.job_id WHERE r.kind = 'srt'),
w AS (SELECT job_id, min(id) AS winner FROM a WHERE status IN ('failed', 'canceled') GROUP BY job_id)
SELECT id, job_id, user_id, -minutes AS delta, 'job:retry' AS reason FROM a UNION ALL
SELECT a.id, a.job_id, a.user_id, a.minutes, 'refund:retry' FROM a LEFT JOIN w ON w.job_id = a.job_id WHERE w.winner IS NULL OR w.winner <> a.id""",
)
def _(v):
    return C.retries(v.artifacts.filter("kind = 'srt'").select("id", "job_id"), v.jobs)


@query("jobs_charged", "SELECT j.user_id, -j.minutes AS delta, 'job' AS reason, 'e' || j.id AS ref FROM jobs j WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.reason = 'job' AND l.ref = 'e' || j.id)")
def _(v):
    return C.charges(v.jobs, v.ledger)


@query("stale_jobs_refunds", "SELECT id, user_id, 'failed' AS status, minutes AS refund FROM jobs WHERE status IN ('queued', 'running')")
def _(v):
    return C.recovered(v.jobs)


_CODES = "CASE WHEN l_quantity > 45 THEN 'too_long' WHEN l_discount < 0.01 THEN 'empty' ELSE 'ok' END"


@query(
    "job_batches",
    f"""
WITH f AS (SELECT l_orderkey % 4000 AS batch, {_CODES} AS code FROM lineitem), b AS (SELECT batch, count(*) AS files, count(*) FILTER (WHERE code = 'ok') AS ok FROM f GROUP BY batch)
SELECT batch, files, CASE WHEN files > 10 THEN 0 ELSE ok END AS taken, CASE WHEN files > 10 OR ok = 0 THEN 422 WHEN ok = files THEN 201 ELSE 207 END AS answer FROM b""",
)
def _(v):
    return C.batches(v.lineitem.select((F.col("l_orderkey") % 4000).alias("batch"), F.expr(_CODES).alias("code")))


@query(
    "job_list_merged",
    """
WITH k AS (SELECT id, status FROM jobs WHERE id % 3 = 0), s AS (SELECT id, 'seen' AS status FROM jobs WHERE id % 5 = 0)
SELECT coalesce(k.id, s.id) AS id, coalesce(s.status, k.status) AS status, k.id IS NULL AS in_front FROM k FULL JOIN s ON s.id = k.id""",
)
def _(v):
    return C.merged_list(v.jobs.filter("id % 3 = 0").select("id", "status"), v.jobs.filter("id % 5 = 0").select("id", F.lit("seen").alias("status")), "id", "id")
