"""Ledger and usage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.operators import ledger as L
from cuelake.plans.registry import query
from cuelake.sources.model import AS_OF

_NOW = f"TIMESTAMP '{AS_OF}'"
_DAY = "DATE '2024-01-30'"


def _double(df, *cols):
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


@query("ledger_balance", "SELECT user_id, CAST(sum(delta) AS DOUBLE) AS balance FROM ledger GROUP BY user_id")
def _(v):
    return _double(L.balances(v.ledger), "balance")


@query(
    "user_balances",
    "SELECT u.id AS user_id, CAST(coalesce(s.b, 0) AS DOUBLE) AS balance FROM users u LEFT JOIN (SELECT user_id, sum(delta) AS b FROM ledger GROUP BY user_id) s ON u.id = s.user_id",
)
def _(v):
    return _double(L.balances_of(v.users, v.ledger), "balance")


@query(
    "ledger_running_balance",
    "SELECT id, user_id, CAST(delta AS DOUBLE) AS delta, CAST(sum(delta) OVER (PARTITION BY user_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS balance FROM ledger",
)
def _(v):
    return _double(L.running_balance(v.ledger), "delta", "balance")


@query(
    "minutes_spent_today",
    f"SELECT user_id, CAST(sum(-delta) AS DOUBLE) AS spent FROM ledger WHERE delta < 0 AND created_at >= {_DAY} GROUP BY user_id",
)
def _(v):
    return _double(L.spent_on(v.ledger, F.expr(_DAY)), "spent")


@query(
    "usage_daily_minutes",
    "SELECT user_id, CAST(created_at AS DATE) AS day, CAST(sum(-delta) AS DOUBLE) AS minutes FROM ledger WHERE delta < 0 GROUP BY ALL",
)
def _(v):
    return _double(L.daily_minutes(v.ledger), "minutes")


@query(
    "usage_streak",
    f"""
WITH d AS (SELECT user_id, CAST(created_at AS DATE) AS day FROM ledger WHERE delta < 0 GROUP BY ALL HAVING sum(-delta) > 0),
n AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM d WHERE day <= {_DAY} AND day > {_DAY} - 30)
SELECT user_id, count(*) AS streak FROM n GROUP BY user_id, island HAVING max(day) = {_DAY}""",
)
def _(v):
    return L.streaks(L.daily_minutes(v.ledger), F.expr(_DAY), 30)


_USAGE = f"""
WITH d AS (SELECT user_id, CAST(created_at AS DATE) AS day, sum(-delta) AS m FROM ledger WHERE delta < 0 AND created_at >= {_DAY} - 29 GROUP BY ALL),
a AS (SELECT user_id, sum(m) AS minutes, count(*) AS active_days FROM d GROUP BY user_id),
j AS (SELECT user_id, count(*) AS jobs, sum(CAST(minutes AS DECIMAL(18,6))) AS job_minutes FROM jobs WHERE created_at >= {_DAY} - 29 GROUP BY user_id),
p AS (SELECT user_id, sum(amount_minor) AS paid FROM payments WHERE status = 'paid' AND created_at >= {_DAY} - 29 GROUP BY user_id),
n AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM d WHERE m > 0 AND day <= {_DAY} AND day > {_DAY} - 30),
s AS (SELECT user_id, count(*) AS streak FROM n GROUP BY user_id, island HAVING max(day) = {_DAY})
SELECT user_id, CAST(coalesce(minutes, 0) AS DOUBLE) AS minutes, coalesce(active_days, 0) AS active_days, coalesce(jobs, 0) AS jobs,
  CAST(coalesce(job_minutes, 0) AS DOUBLE) AS job_minutes, CAST(coalesce(paid, 0) AS BIGINT) AS paid_minor, coalesce(streak, 0) AS streak
FROM a FULL JOIN j USING (user_id) FULL JOIN p USING (user_id) LEFT JOIN s USING (user_id)"""


@query("usage_summary", _USAGE)
def _(v):
    jobs = v.jobs.withColumn("minutes", F.col("minutes").cast("decimal(18,6)"))
    return _double(L.usage_summary(v.ledger, jobs, v.payments, F.expr(_DAY), 30), "minutes", "job_minutes")


@query("usage_jobs_by_type", "SELECT user_id, type, count(*) AS n FROM jobs GROUP BY user_id, type")
def _(v):
    return v.jobs.groupBy("user_id", "type").agg(F.count("*").alias("n"))


@query("usage_totals", "SELECT user_id, count(*) AS jobs, CAST(sum(CAST(minutes AS DECIMAL(18,6))) AS DOUBLE) AS minutes FROM jobs GROUP BY user_id")
def _(v):
    return v.jobs.groupBy("user_id").agg(F.count("*").alias("jobs"), F.sum(F.col("minutes").cast("decimal(18,6)")).cast("double").alias("minutes"))


@query("usage_paid", "SELECT user_id, CAST(sum(amount_minor) AS BIGINT) AS paid_minor FROM payments WHERE status = 'paid' GROUP BY user_id")
def _(v):
    return v.payments.filter("status = 'paid'").groupBy("user_id").agg(F.sum("amount_minor").alias("paid_minor"))


@query(
    "usage_last_days",
    """
WITH d AS (SELECT user_id, CAST(created_at AS DATE) AS day, sum(-delta) AS m FROM ledger WHERE delta < 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS r FROM d)
SELECT user_id, day, CAST(m AS DOUBLE) AS minutes, CAST(floor(CAST(m AS DOUBLE) / greatest(CAST(max(m) OVER (PARTITION BY user_id) AS DOUBLE), 1.0::DOUBLE) * 100 + 0.5::DOUBLE) AS BIGINT) AS bar FROM r WHERE r <= 14""",
)
def _(v):
    from pyspark.sql import Window

    last = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("day")))
    rows = _double(L.daily_minutes(v.ledger).withColumn("r", last).filter("r <= 14").drop("r"), "minutes")
    top = F.greatest(F.max("minutes").over(Window.partitionBy("user_id")), F.lit(1.0))
    return rows.withColumn("bar", F.floor(F.col("minutes") / top * 100 + F.lit(0.5)))


@query("ledger_history", "SELECT id, user_id, CAST(delta AS DOUBLE) AS delta, reason, ref FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS r FROM ledger) WHERE r <= 50")
def _(v):
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("id")))
    return _double(v.ledger.withColumn("r", r).filter("r <= 50").select("id", "user_id", "delta", "reason", "ref"), "delta")


@query(
    "payment_plans",
    """
SELECT id, amount_minor, CASE WHEN amount_minor <= 0 THEN NULL
  WHEN upper(currency) = 'USD' AND amount_minor = 900 THEN 'pro' WHEN upper(currency) = 'USD' AND amount_minor = 2500 THEN 'studio'
  WHEN upper(currency) = 'UZS' AND amount_minor = 12000000 THEN 'pro_uzs' WHEN upper(currency) = 'RUB' AND amount_minor = 90000 THEN 'pro_rub'
  WHEN upper(currency) = 'UZS' AND amount_minor = 30000000 THEN 'studio_uzs' WHEN upper(currency) = 'RUB' AND amount_minor = 250000 THEN 'studio_rub' END AS plan_key
FROM payments""",
)
def _(v):
    return L.plan_of_payment(v.payments).select("id", "amount_minor", "plan_key")


@query("payments_idempotent", "SELECT external_id, min(id) AS id, CAST(arg_min(amount_minor, id) AS BIGINT) AS amount_minor FROM payments GROUP BY external_id")
def _(v):
    return L.first_payments(v.payments).select("external_id", "id", "amount_minor")


@query(
    "payments_credited",
    "SELECT id, external_id FROM payments p WHERE EXISTS (SELECT 1 FROM ledger l WHERE l.ref = p.external_id AND l.reason LIKE 'payment:%')",
)
def _(v):
    credits = v.ledger.filter(F.col("reason").startswith("payment:"))
    return v.payments.join(credits, F.col("external_id") == F.col("ref"), "left_semi").select("id", "external_id")


@query(
    "payments_uncredited",
    """
WITH f AS (SELECT external_id, min(id) AS id FROM payments GROUP BY external_id)
SELECT p.id, p.external_id, p.minutes FROM payments p JOIN f ON p.id = f.id WHERE p.minutes > 0 AND p.minutes <= 600
AND NOT EXISTS (SELECT 1 FROM ledger l WHERE l.ref = p.external_id AND l.reason LIKE 'payment:%')""",
)
def _(v):
    return L.uncredited(v.payments, v.ledger).select("id", "external_id", "minutes")


@query("refunds", "SELECT DISTINCT user_id, ref FROM ledger WHERE reason LIKE 'refund:%'")
def _(v):
    return v.ledger.filter(F.col("reason").startswith("refund:")).select("user_id", "ref").distinct()


@query(
    "plan_upgrades",
    """
WITH f AS (SELECT external_id, min(id) AS id FROM payments GROUP BY external_id),
p AS (SELECT user_id, max(CASE WHEN upper(currency) = 'UZS' AND amount_minor = 12000000 THEN 1 WHEN upper(currency) = 'RUB' AND amount_minor = 90000 THEN 1
  WHEN upper(currency) = 'USD' AND amount_minor = 900 THEN 1 WHEN upper(currency) = 'USD' AND amount_minor = 2500 THEN 2 WHEN upper(currency) = 'UZS' AND amount_minor = 30000000 THEN 2
  WHEN upper(currency) = 'RUB' AND amount_minor = 250000 THEN 2 ELSE 0 END) AS paid FROM payments JOIN f USING (id) GROUP BY user_id)
SELECT u.id AS user_id, u.plan AS plan_before, CASE greatest(CASE u.plan WHEN 'free' THEN 0 WHEN 'pro' THEN 1 ELSE 2 END, coalesce(p.paid, 0)) WHEN 0 THEN 'free' WHEN 1 THEN 'pro' ELSE 'studio' END AS plan_after
FROM users u LEFT JOIN p ON u.id = p.user_id""",
)
def _(v):
    return L.upgrades(v.users, v.payments)


@query(
    "balance_low",
    "SELECT user_id, CAST(sum(delta) AS DOUBLE) AS balance FROM ledger JOIN users ON users.id = ledger.user_id GROUP BY user_id HAVING sum(delta) > 0 AND sum(delta) < 1",
)
def _(v):
    return _double(L.low_balances(v.users, v.ledger), "balance")


#: The driver's sums are larger; what is over whole minutes makes balances of both kinds.
@query(
    "balance_low_planted",
    "SELECT user_id, CAST(sum(delta % 1) AS DOUBLE) AS balance FROM ledger JOIN users ON users.id = ledger.user_id GROUP BY user_id HAVING sum(delta % 1) > 0 AND sum(delta % 1) < 1",
)
def _(v):
    return _double(L.low_balances(v.users, v.ledger.withColumn("delta", F.col("delta") % 1)), "balance")


#: Daily minutes by plan.
CAPS = {"free": 30.0, "pro": 240.0, "studio": 600.0}


@query(
    "quota_left",
    f"""
WITH s AS (SELECT user_id, sum(-delta) AS spent FROM ledger WHERE delta < 0 AND created_at >= {_DAY} GROUP BY user_id)
SELECT u.id AS user_id, u.plan, CAST(coalesce(spent, 0) AS DOUBLE) AS spent,
  CAST(round(greatest(0::DECIMAL(28,4), CASE u.plan WHEN 'free' THEN 30 WHEN 'pro' THEN 240 ELSE 600 END::DECIMAL(28,4) - coalesce(spent, 0)::DECIMAL(28,4)), 1) AS DOUBLE) AS "left"
FROM users u LEFT JOIN s ON u.id = s.user_id""",
)
def _(v):
    return L.quota_left(v.users, v.ledger, F.expr(_DAY), CAPS)


@query(
    "admin_status",
    f"""
SELECT (SELECT count(*) FROM users) AS users, (SELECT count(*) FROM users WHERE created_on >= {_DAY}) AS new_users,
  (SELECT count(*) FROM jobs) AS jobs, (SELECT count(*) FROM jobs WHERE status IN ('queued', 'running')) AS active, (SELECT count(*) FROM jobs WHERE status = 'done') AS done,
  (SELECT count(*) FROM jobs WHERE status = 'failed') AS failed, (SELECT CAST(sum(amount_minor) AS BIGINT) FROM payments WHERE status = 'paid') AS revenue,
  (SELECT CAST(coalesce(sum(amount_minor), 0) AS BIGINT) FROM payments WHERE status = 'paid' AND created_at >= {_DAY}) AS revenue_today,
  (SELECT CAST(sum(delta) AS DOUBLE) FROM ledger WHERE delta > 0) AS credited, (SELECT CAST(sum(-delta) AS DOUBLE) FROM ledger WHERE delta < 0) AS spent,
  (SELECT count(*) FROM sessions) AS sessions, (SELECT count(*) FROM api_keys WHERE revoked_at IS NULL) AS api_keys""",
)
def _(v):
    day = F.expr(_DAY)
    n = F.count("*")
    parts = [
        v.users.agg(n.alias("users"), F.count_if(F.col("created_on") >= day).alias("new_users")),
        v.jobs.agg(
            n.alias("jobs"),
            F.count_if(F.col("status").isin("queued", "running")).alias("active"),
            F.count_if(F.col("status") == "done").alias("done"),
            F.count_if(F.col("status") == "failed").alias("failed"),
        ),
        v.payments.filter("status = 'paid'").agg(
            F.sum("amount_minor").alias("revenue"), F.coalesce(F.sum(F.when(F.col("created_at") >= day, F.col("amount_minor"))), F.lit(0)).alias("revenue_today")
        ),
        v.ledger.agg(
            F.sum(F.when(F.col("delta") > 0, F.col("delta"))).cast("double").alias("credited"), F.sum(F.when(F.col("delta") < 0, -F.col("delta"))).cast("double").alias("spent")
        ),
        v.sessions.agg(n.alias("sessions")),
        v.api_keys.agg(F.count_if(F.col("revoked_at").isNull()).alias("api_keys")),
    ]
    out = parts[0]
    for p in parts[1:]:  # frames of one row each
        out = out.crossJoin(p)
    return out


@query("admin_jobs_by_type", "SELECT type, count(*) AS n FROM jobs GROUP BY type")
def _(v):
    return v.jobs.groupBy("type").agg(F.count("*").alias("n"))


@query("revenue_by_currency", "SELECT upper(currency) AS currency, CAST(sum(amount_minor) AS BIGINT) AS amount_minor, count(*) AS n FROM payments WHERE status = 'paid' GROUP BY 1")
def _(v):
    return v.payments.filter("status = 'paid'").groupBy(F.upper("currency").alias("currency")).agg(F.sum("amount_minor").alias("amount_minor"), F.count("*").alias("n"))
