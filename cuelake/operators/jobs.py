"""Job, artifact, share, session, key, webhook and notification operators over append-only tables.

"Latest" rows are aggregates (``max_by``), not sorts; pages are top-k; membership tests are semi and anti joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses, progress by step, rate limits by path prefix.
ACTIVE = ("queued", "running")
FINISHED = ("done", "failed", "canceled")
TRANSITIONS = {"queued": ("running", "canceled", "failed"), "running": ("done", "failed"), "failed": ("queued",), "canceled": ("queued",)}
ENDPOINT_LIMITS = (
    ("/api/auth/", 20),
    ("/api/jobs", 60),
    ("/api/glossary", 120),
    ("/api/account/export", 6),
    ("/api/admin/", 30),
    ("/api/v1/ling/align", 12),
    ("/api/v1/ling/words", 12),
    ("/api/v1/ling", 60),
)
DEFAULT_LIMIT = 300
SESSION_DAYS, SESSION_RENEW_S = 30, 3600


def latest_event(events: DataFrame) -> DataFrame:
    """job_id and the step, message and data of its event with the greatest id."""
    last = F.max_by(F.struct("step", "message", "data"), "id").alias("e")
    return events.groupBy("job_id").agg(last, F.max("id").alias("id")).select("job_id", "id", "e.*")


def timeline(events: DataFrame) -> DataFrame:
    """Events with their place in the job's timeline; data that isn't a JSON object counts as {}."""
    n = F.row_number().over(Window.partitionBy("job_id").orderBy("id"))
    kept = F.when(F.trim("data").startswith("{") & F.from_json("data", "map<string,string>").isNotNull(), F.col("data")).otherwise(F.lit("{}"))
    return events.select("job_id", n.alias("seq"), "id", "step", "message", kept.alias("data"))


def latest_artifacts(artifacts: DataFrame) -> DataFrame:
    """job_id, kind, path of the greatest id."""
    return artifacts.groupBy("job_id", "kind").agg(F.max_by("path", F.struct("id", "path")).alias("path"))


def artifact_maps(artifacts: DataFrame) -> DataFrame:
    """job_id and a map kind -> latest path."""
    pairs = F.array_sort(F.collect_list(F.struct("kind", "path")))
    return latest_artifacts(artifacts).groupBy("job_id").agg(F.map_from_entries(pairs).alias("artifacts"))


def page(jobs: DataFrame, limit: int, cursor: tuple | None = None, status: str | None = None, kind: str | None = None) -> DataFrame:
    """A keyset page, newest first; cursor is (created_at, id) of the last row seen."""
    rows = jobs
    if status:
        rows = rows.filter(F.col("status") == status)
    if kind:
        rows = rows.filter(F.col("type") == kind)
    if cursor:
        at, last = F.lit(cursor[0]), F.lit(cursor[1])
        rows = rows.filter((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < last)))
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def cursor_of(created_at: Column, job_id: Column) -> Column:
    """The page cursor: URL-safe base64 of "created_at|id"."""
    text = F.concat(F.date_format(created_at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00|"), job_id.cast("string"))
    return F.translate(F.base64(F.encode(text, "UTF-8")), "+/", "-_")


def jobs_view(jobs: DataFrame, artifacts: DataFrame, events: DataFrame) -> DataFrame:
    """Jobs with their artifacts and, while active, the latest event's step."""
    last = latest_event(events).select(F.col("job_id").alias("_job"), F.col("step").alias("_step"))
    count = latest_artifacts(artifacts).groupBy("job_id").agg(F.count("*").alias("kinds"))
    out = jobs.join(count, jobs.id == count.job_id, "left").drop("job_id").join(last, jobs.id == F.col("_job"), "left")
    step = F.when(F.col("status").isin(*ACTIVE), F.col("_step"))
    return out.select(*[F.col(c) for c in jobs.columns], F.coalesce("kinds", F.lit(0)).alias("kinds"), step.alias("latest_step"))


def finished_before(jobs: DataFrame, at: Column, days: int) -> DataFrame:
    return jobs.filter(F.col("status").isin(*FINISHED) & (F.col("updated_at") < at - F.expr(f"INTERVAL {int(days)} DAY")))


def purge(rows: DataFrame, gone: DataFrame, key: str = "job_id") -> DataFrame:
    """Rows of a child table whose job stays."""
    return rows.join(gone.select(F.col("id").alias("_gone")), F.col(key) == F.col("_gone"), "left_anti")


def options(meta: Column) -> Column:
    """The four options of a job's meta, false where unset."""
    return F.struct(*[F.coalesce(F.get_json_object(meta, f"$.{k}").cast("boolean"), F.lit(False)).alias(k) for k in ("diarize", "polish", "align", "words")])


def session_users(sessions: DataFrame, users: DataFrame, now_s: Column) -> DataFrame:
    """Valid sessions with their users, and whether they are to be renewed; a session without an expiry stays valid."""
    expiry, seen = F.col("expires_at").cast("bigint"), F.col("last_seen_at").cast("bigint")
    rows = sessions.filter(expiry.isNull() | (expiry >= now_s)).join(users, sessions.user_id == users.id)
    renew = seen.isNull() | (now_s - seen > SESSION_RENEW_S)
    return rows.select("token", "user_id", "plan", renew.alias("renew"), F.when(renew, now_s + SESSION_DAYS * 86400).otherwise(expiry).alias("expires_s"))


def subscribed(webhooks: DataFrame, event: str) -> DataFrame:
    """Active hooks whose list of events names the event."""
    names = F.filter(F.transform(F.split("events", ","), lambda x: F.trim(x)), lambda x: x != "")
    return webhooks.filter((F.col("active") == 1) & F.array_contains(names, event))


def endpoint_limit(path: Column) -> Column:
    out = F.lit(DEFAULT_LIMIT)
    for prefix, limit in reversed(ENDPOINT_LIMITS):
        out = F.when(path.startswith(prefix), limit).otherwise(out)
    return out


def rate_class(path: Column) -> Column:
    out = F.coalesce(F.nullif(F.substring_index(path, "/", 3), F.lit("")), path)
    for prefix, _ in reversed(ENDPOINT_LIMITS):
        out = F.when(path.startswith(prefix), F.lit(prefix)).otherwise(out)
    return out


def latest_terms(terms: DataFrame) -> DataFrame:
    """user_id, src_term and the target term last written for it."""
    return terms.groupBy("user_id", "src_term").agg(F.max_by("tgt_term", F.struct("id", "tgt_term")).alias("tgt_term"))


def flag_bucket(flag: Column, user: Column) -> Column:
    """md5("flag:user") as a number, modulo 100, digit by digit."""
    digest = F.md5(F.concat(flag, F.lit(":"), user.cast("string")))
    digits = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.instr(F.lit("0123456789abcdef"), digest.substr(i, F.lit(1))) - 1)
    return F.aggregate(digits, F.lit(0), lambda a, d: (a * 16 + d) % 100)


def flag_enabled(enabled: Column, min_plan: Column, pct: Column, flag: Column, user: Column, plan: Column) -> Column:
    """Whether a flag is on for a user: unknown flags are off, then the switch, the plan's rank, and the share of users."""
    from .ledger import PLAN_RANK

    rank = F.create_map(*[F.lit(x) for kv in PLAN_RANK.items() for x in kv])
    allowed = F.coalesce(rank[plan], F.lit(0)) >= F.coalesce(rank[min_plan], F.lit(0))
    share = F.when(pct >= 100, True).when(pct <= 0, False).when(user.isNull(), False).otherwise(flag_bucket(flag, user) < pct)
    return F.coalesce(enabled & allowed & share, F.lit(False))


def throttled(hits: DataFrame, seconds: int, most: int) -> DataFrame:
    """Hits with how many of the key's hits lie in the window that ends with them, and whether that is over the limit.

    Counts all recorded hits; ``cuelake.streaming.stateful.admit`` counts admitted ones only.
    """
    at = F.unix_micros("at")
    w = Window.partitionBy("key").orderBy(at).rangeBetween(-seconds * 1_000_000 + 1, 0)
    n = F.count("*").over(w)
    return hits.select("id", "key", n.alias("in_window"), (n > most).alias("over"))
