"""An account's data as one JSON text: lists of what belongs to it, the newest first, each within its cap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of each list at most, version of the format.
MOST = {"jobs": 9999, "payments": 100, "notifications": 9999, "shares": 50}
VERSION = 1


def moment(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def listed(rows: DataFrame, owner: str, name: str, order: list[str], fields: dict[str, Column], most: int | None = None) -> DataFrame:
    """user, and under a name the array of a user's rows (as structs of fields) in descending order, at most so many.

    What is over the cap goes before anything is gathered, so a user's list is bounded where there is a cap.
    """
    row = F.struct(*[c.alias(k) for k, c in fields.items()])
    rows = rows.select(F.col(owner).alias("user"), *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], row.alias("row"))
    keys = [f"o{k}" for k in range(len(order))]
    if most is not None:
        newest = Window.partitionBy("user").orderBy(*[F.desc(k) for k in keys])
        rows = rows.withColumn("r", F.row_number().over(newest)).filter(F.col("r") <= most)
    per = rows.groupBy("user").agg(F.sort_array(F.collect_list(F.struct(*keys, "row")), asc=False).alias("rs"))
    return per.select("user", F.col("rs.row").alias(name))


def exported(users: DataFrame, balances: DataFrame, lists: list[DataFrame], at: str) -> DataFrame:
    """user_id, body. users: id, name, contact, plan, created_at (text); balances: user_id, balance; lists: from ``listed``. Users without rows have empty lists."""
    rows = users.select(F.col("id").alias("user"), F.struct("name", "contact", "plan", "created_at").alias("who"))
    balance = balances.select(F.col("user_id").alias("user"), F.round(F.col("balance").cast("double"), 4).alias("balance"))
    rows = reduce(lambda a, b: a.join(b, "user", "left"), lists, rows.join(balance, "user", "left"))
    names = [next(c for c in x.columns if c != "user") for x in lists]
    kinds = {c: rows.schema[c].dataType.simpleString() for c in names}
    body = F.struct(
        F.lit(at).alias("exported_at"), F.lit(VERSION).alias("format_version"), F.col("who").alias("user"), F.coalesce("balance", F.lit(0.0)).alias("balance_minutes"),
        *[F.coalesce(c, F.array().cast(kinds[c])).alias(c) for c in names],
    )
    return rows.select(F.col("user").alias("user_id"), F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))
