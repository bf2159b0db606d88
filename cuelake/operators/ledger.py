"""Ledger, payments and plan operators over append-only tables.

A balance is always a sum of signed deltas. Sums are made per key before the shuffle; only keys and sums travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Plan ranks, minutes by plan, and prices in minor units by (plan key, currency, price, plan, minutes).
PLAN_RANK = {"free": 0, "pro": 1, "studio": 2}
PRICES = (
    ("pro", "USD", 900, "pro", 120),
    ("studio", "USD", 2500, "studio", 500),
    ("pro_uzs", "UZS", 12_000_000, "pro", 120),
    ("pro_rub", "RUB", 90_000, "pro", 120),
    ("studio_uzs", "UZS", 30_000_000, "studio", 500),
    ("studio_rub", "RUB", 250_000, "studio", 500),
)
#: Fixed value: most minutes that one payment may credit.
CREDIT_MOST = 600
LOW_BALANCE = 1.0


def balances(ledger: DataFrame) -> DataFrame:
    """user_id, balance."""
    return ledger.groupBy("user_id").agg(F.sum("delta").alias("balance"))


def balances_of(users: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every user's balance; 0 without entries."""
    sums = balances(ledger)
    return users.join(sums, users.id == sums.user_id, "left").select(users.id.alias("user_id"), F.coalesce("balance", F.lit(0)).alias("balance"))


def running_balance(ledger: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return ledger.select("id", "user_id", "delta", F.sum("delta").over(w).alias("balance"))


def spent_on(ledger: DataFrame, day: Column) -> DataFrame:
    """Minutes debited from the start of ``day`` on."""
    return ledger.filter((F.col("delta") < 0) & (F.col("created_at") >= day)).groupBy("user_id").agg(F.sum(-F.col("delta")).alias("spent"))


def daily_minutes(ledger: DataFrame, since: Column | None = None) -> DataFrame:
    rows = ledger.filter("delta < 0")
    rows = rows if since is None else rows.filter(F.col("created_at") >= since)
    return rows.groupBy("user_id", F.to_date("created_at").alias("day")).agg(F.sum(-F.col("delta")).alias("minutes"))


def streaks(daily: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Length of each user's run of days with use that ends on ``as_of``, by islands of consecutive days."""
    active = daily.filter((F.col("minutes") > 0) & (F.col("day") <= as_of) & (F.col("day") > F.date_sub(as_of, days)))
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("day"))
    islands = active.withColumn("island", F.date_sub("day", n)).groupBy("user_id", "island").agg(F.count("*").alias("streak"), F.max("day").alias("last"))
    return islands.filter(F.col("last") == as_of).select("user_id", "streak")


def usage_summary(ledger: DataFrame, jobs: DataFrame, payments: DataFrame, as_of: Column, days: int) -> DataFrame:
    """One row per user seen: debited minutes, jobs, their minutes, paid minor units and the streak, over the last days."""
    since = F.date_sub(as_of, days - 1)
    daily = daily_minutes(ledger, since)
    debit = daily.groupBy("user_id").agg(F.sum("minutes").alias("minutes"), F.count("*").alias("active_days"))
    done = jobs.filter(F.col("created_at") >= since).groupBy("user_id").agg(F.count("*").alias("jobs"), F.sum("minutes").alias("job_minutes"))
    paid = payments.filter((F.col("status") == "paid") & (F.col("created_at") >= since)).groupBy("user_id").agg(F.sum("amount_minor").alias("paid_minor"))
    out = debit.join(done, "user_id", "full").join(paid, "user_id", "full").join(streaks(daily, as_of, days), "user_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("minutes", "active_days", "jobs", "job_minutes", "paid_minor", "streak")}
    return out.withColumns(zero)


def plan_of_payment(payments: DataFrame) -> DataFrame:
    """payments with plan_key, plan and plan_minutes where amount and currency are a price; never for amounts of 0 or less."""
    prices = payments.sparkSession.createDataFrame(list(PRICES), "plan_key string, _currency string, _price long, plan string, plan_minutes int")
    on = (F.upper("currency") == F.col("_currency")) & (F.col("amount_minor") == F.col("_price")) & (F.col("amount_minor") > 0)
    return payments.join(F.broadcast(prices), on, "left").drop("_currency", "_price")


def first_payments(payments: DataFrame) -> DataFrame:
    """The first row of each external_id: a repeated notice changes nothing."""
    first = payments.groupBy("external_id").agg(F.min("id").alias("id"))
    return payments.join(first, ["external_id", "id"], "left_semi")


def uncredited(payments: DataFrame, ledger: DataFrame) -> DataFrame:
    """Paid notices with no credit in the ledger, of more than 0 and at most CREDIT_MOST minutes."""
    credits = ledger.filter(F.col("reason").startswith("payment:")).select("ref")
    due = first_payments(payments).filter((F.col("minutes") > 0) & (F.col("minutes") <= CREDIT_MOST))
    return due.join(credits, due.external_id == credits.ref, "left_anti")


def upgrades(users: DataFrame, payments: DataFrame) -> DataFrame:
    """user_id, plan after payments: the highest of the plan held and the plans paid for."""
    rank = F.create_map(*[F.lit(x) for kv in PLAN_RANK.items() for x in kv])
    paid = plan_of_payment(first_payments(payments)).filter("plan is not null").groupBy("user_id").agg(F.max(rank[F.col("plan")]).alias("paid"))
    best = F.greatest(rank[F.col("plan")], F.coalesce("paid", F.lit(0)))
    name = F.element_at(F.array(*[F.lit(p) for p in PLAN_RANK]), best + 1)
    return users.join(paid, users.id == paid.user_id, "left").select(users.id.alias("user_id"), users.plan.alias("plan_before"), name.alias("plan_after"))


def low_balances(users: DataFrame, ledger: DataFrame) -> DataFrame:
    """Users to be told: a balance above 0 and under LOW_BALANCE."""
    return balances_of(users, ledger).filter((F.col("balance") > 0) & (F.col("balance") < LOW_BALANCE))


def quota_left(users: DataFrame, ledger: DataFrame, day: Column, caps: dict[str, float]) -> DataFrame:
    """user_id, plan, spent today and what is left of the plan's cap, rounded to a tenth, halves up. The difference stays decimal, so a half is a half."""
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col("plan")]
    today = spent_on(ledger, day)
    out = users.join(today, users.id == today.user_id, "left").select(users.id.alias("user_id"), "plan", F.coalesce("spent", F.lit(0)).cast("decimal(28,4)").alias("spent"))
    left = F.round(F.greatest(F.lit(0).cast("decimal(28,4)"), cap.cast("decimal(8,4)") - F.col("spent")), 1).cast("double")
    return out.select("user_id", "plan", F.col("spent").cast("double").alias("spent"), left.alias("left"))
