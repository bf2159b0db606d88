"""Joins on timelines.

An overlap join first meets on time buckets of a fixed width, so it is an equi-join that shuffles by (document, bucket); the
exact test follows. A pair is kept in the bucket where its overlap begins, so each pair comes once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _bucketed(rows: DataFrame, start: str, end: str, width: float) -> DataFrame:
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    return rows.withColumn("_b", F.explode(F.sequence(cell(start), F.greatest(cell(start), cell(end)))))


def overlaps(left: DataFrame, right: DataFrame, key: str, width: float = 10.0) -> DataFrame:
    """Pairs of rows that share more than a moment. left: key, s, e; right: key, rs, re; the other columns' names differ."""
    a, b = _bucketed(left, "s", "e", width), _bucketed(right, "rs", "re", width)
    overlap = F.least("e", "re") - F.greatest("s", "rs")
    home = F.floor(F.greatest("s", "rs") / width).cast("long")
    return a.join(b, [key, "_b"]).filter((overlap > 0) & (F.col("_b") == home)).withColumn("overlap", overlap).drop("_b")


def best_overlap(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, width: float = 10.0) -> DataFrame:
    """Each left row with the right row that it shares most time with, the first in order of right_id on ties; null without any."""
    pairs = overlaps(left, right, key, width)
    first = Window.partitionBy(key, left_id).orderBy(F.desc("overlap"), right_id)
    best = pairs.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select(key, left_id, right_id, "overlap")
    return left.join(best, [key, left_id], "left")


def latest_at(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, tag: str) -> DataFrame:
    """As-of join: each point with the tag of the last interval that starts at or before it, if that one still holds it."""
    last = F.last(F.when(F.col("_i"), F.struct(F.col("_tag"), F.col("_end"))), ignorenulls=True)
    left = points.select("*", F.lit(False).alias("_i"), F.col(at).alias("_t"))
    right = intervals.select(F.col(key), F.col(start).alias("_t"), F.col(tag).alias("_tag"), F.col(end).alias("_end"), F.lit(True).alias("_i"))
    rows = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_t", F.desc("_i"), "_tag").rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumn("_last", last.over(w)).filter(~F.col("_i"))
    return held.select(*points.columns, F.when(F.col("_last._end") >= F.col(at), F.col("_last._tag")).alias(tag))


def packed_starts(rows: DataFrame, key: str, order: str, start: str, length: str) -> DataFrame:
    """Starts such that no row begins before the one ahead of it has ended.

    start_i = P(i) + max over j <= i of (s_j - P(j)), P the sum of the lengths before a row: two windows instead of a loop.
    """
    w = Window.partitionBy(key).orderBy(order)
    before = F.sum(F.greatest(F.lit(0), F.col(length))).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.greatest(F.lit(0), F.col(length))
    out = rows.withColumn("_p", before)
    head = F.max(F.col(start) - F.col("_p")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("placed", F.col("_p") + F.greatest(head, F.lit(0) if start.endswith("_ms") else F.lit(0.0))).drop("_p")


def overlap_seconds(rows: DataFrame, key: str, order: str, start: str, end: str) -> DataFrame:
    before = F.lag(end).over(Window.partitionBy(key).orderBy(order))
    return rows.select(key, F.greatest(F.lit(0), before - F.col(start)).alias("o")).groupBy(key).agg(F.sum("o").alias("overlap"))


def nearest_gap(points: DataFrame, gaps: DataFrame, key: str, reach: float, pad: float, least: float) -> DataFrame:
    """Each point (key, p, t) with where the nearest pause lets it move: t clamped into a pause less its pad, at most ``reach`` away.

    Moves under ``least`` don't count; ties go to the smaller time. gaps: key, gs, ge. Points without a pause in reach keep null.
    """
    usable = gaps.filter(F.col("ge") - F.col("gs") > 2 * pad).select(key, (F.col("gs") + pad).alias("rs"), (F.col("ge") - pad).alias("re"))
    near = points.select(key, "p", "t", (F.col("t") - reach).alias("s"), (F.col("t") + reach).alias("e"))
    a, b = _bucketed(near, "s", "e", 10.0), _bucketed(usable, "rs", "re", 10.0)
    lo, hi = F.greatest("s", "rs"), F.least("e", "re")
    meets = a.join(b, [key, "_b"]).filter(lo <= hi)
    to = F.greatest(lo, F.least(F.col("t"), hi))
    moves = meets.select(key, "p", "t", to.alias("to")).withColumn("d", F.abs(F.col("to") - F.col("t"))).filter(F.col("d") >= least)
    best = moves.groupBy(key, "p").agg(F.min(F.struct("d", "to")).alias("m")).select(key, "p", F.col("m.to").alias("to"), F.col("m.d").alias("moved"))
    return points.join(best, [key, "p"], "left")

