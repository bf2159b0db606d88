"""Envelope queries: gates, speech runs, pauses and cuts moved into pauses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuelake.operators import intervals as I
from cuelake.operators import signal as S
from cuelake.plans.registry import query

_RANK = "CAST(round_even((len(o) - 1) * {p}::DOUBLE, 0) AS INTEGER) + 1"
_GATES = f"""
WITH o AS (SELECT tape, count(*) AS frames, list_sort(list(level)) AS o FROM levels GROUP BY tape),
p AS (SELECT tape, frames, o[{_RANK.format(p=0.1)}] AS noise_floor, o[{_RANK.format(p=0.9)}] AS top FROM o),
d AS (SELECT *, 20 * log10(greatest(noise_floor, 1e-9)) AS n_db, 20 * log10(greatest(top, 1e-9)) AS tape_db FROM p),
g AS (SELECT *, least(greatest((greatest(n_db, tape_db - 40) + tape_db) / 2, n_db + 6), tape_db - 12) AS gate_db, tape_db < -46 AS silent FROM d),
h AS (SELECT *, pow(10, gate_db / 20) AS hi, pow(10, (gate_db - 3) / 20) AS lo FROM g)"""
_RUNS = (
    _GATES
    + """, s AS (SELECT l.tape, l.f, coalesce(last_value(CASE WHEN level >= hi THEN true WHEN level < lo THEN false END IGNORE NULLS) OVER (PARTITION BY l.tape ORDER BY f ROWS UNBOUNDED PRECEDING), false) AS live FROM levels l JOIN h ON h.tape = l.tape WHERE NOT silent),
i AS (SELECT tape, f, f - row_number() OVER (PARTITION BY tape ORDER BY f) AS i FROM s WHERE live),
r AS (SELECT tape, min(f) AS first, max(f) AS last FROM i GROUP BY tape, i)"""
)
_PAUSES = (
    _RUNS
    + """, e AS (SELECT tape, CAST(first AS BIGINT) AS first, last FROM r UNION ALL SELECT tape, frames, NULL FROM h WHERE NOT silent),
b AS (SELECT tape, coalesce(lag(last) OVER (PARTITION BY tape ORDER BY first) + 1, 0) AS begins, first FROM e),
z AS (SELECT tape, round(begins * 0.02::DOUBLE, 3) AS gs, round(first * 0.02::DOUBLE, 3) AS ge FROM b)"""
)


def gates_sql(levels: str) -> str:
    """The tables o to h, for a query with a table of levels of its own."""
    return _GATES.replace("FROM levels", f"FROM {levels}")


@query("tape_gates", _GATES + " SELECT tape, frames, round(noise_floor, 6) AS noise_floor, round(gate_db, 3) AS gate_db, round(tape_db, 3) AS tape_db, silent FROM g")
def _(v):
    return S.gates(v.levels).select("tape", "frames", F.round("noise_floor", 6).alias("noise_floor"), F.round("gate_db", 3).alias("gate_db"), F.round("tape_db", 3).alias("tape_db"), "silent")


@query("speech_runs", _RUNS + " SELECT tape, first, last FROM r")
def _(v):
    return S.speech_runs(v.levels, S.gates(v.levels))


@query("pauses", _PAUSES + " SELECT tape, gs, ge FROM z WHERE ge - gs >= 0.06")
def _(v):
    gate = S.gates(v.levels)
    return S.pauses(S.speech_runs(v.levels, gate), gate)


@query(
    "speech_seconds",
    _RUNS + " SELECT h.tape, coalesce(round(sum(last - first + 1) * 0.02::DOUBLE, 3), 0) AS seconds FROM h LEFT JOIN r ON r.tape = h.tape GROUP BY h.tape",
)
def _(v):
    gate = S.gates(v.levels)
    n = S.speech_runs(v.levels, gate).groupBy("tape").agg(F.sum(F.col("last") - F.col("first") + 1).alias("n"))
    return gate.join(n, "tape", "left").select("tape", F.coalesce(F.round(F.col("n") * 0.02, 3), F.lit(0.0)).alias("seconds"))


@query(
    "cuts_snapped",
    _PAUSES
    + """, u AS (SELECT tape, gs + 0.03::DOUBLE AS rs, ge - 0.03::DOUBLE AS re FROM z WHERE ge - gs >= 0.06 AND ge - gs > 0.06::DOUBLE),
pt AS (SELECT tape, p, p * 0.3::DOUBLE AS t FROM (SELECT tape, unnest(range(1, 5)) AS p FROM h)),
m AS (SELECT pt.tape, pt.p, greatest(greatest(t - 0.6::DOUBLE, rs), least(t, least(t + 0.6::DOUBLE, re))) AS to_, t FROM pt JOIN u ON u.tape = pt.tape AND greatest(t - 0.6::DOUBLE, rs) <= least(t + 0.6::DOUBLE, re)),
k AS (SELECT tape, p, arg_min(to_, (abs(to_ - t), to_)) AS to_ FROM m WHERE abs(to_ - t) >= 0.02::DOUBLE GROUP BY tape, p)
SELECT pt.tape, pt.p, round(k.to_, 6) AS "to" FROM pt LEFT JOIN k ON k.tape = pt.tape AND k.p = pt.p""",
)
def _(v):
    gate = S.gates(v.levels)
    gaps = S.pauses(S.speech_runs(v.levels, gate), gate)
    points = gate.select("tape", F.explode(F.sequence(F.lit(1), F.lit(4)).cast("array<bigint>")).alias("p")).withColumn("t", F.col("p") * 0.3)
    return I.nearest_gap(points, gaps, "tape", 0.6, S.PAD, S.MIN_SHIFT).select("tape", "p", F.round("to", 6).alias("to"))


@query("level_histogram", "SELECT CAST(floor(level * 50) AS BIGINT) AS bin, count(*) AS n FROM levels GROUP BY 1")
def _(v):
    return v.levels.groupBy(F.floor(F.col("level") * 50).alias("bin")).agg(F.count("*").alias("n"))


@query("dips", "SELECT tape, f // 10 AS w, arg_min(f, (round(level, 9), abs(f % 10 - 5), f)) AS frame FROM levels GROUP BY 1, 2")
def _(v):
    key = F.struct(F.round("level", 9), F.abs(F.col("f") % 10 - 5), F.col("f"))
    return v.levels.groupBy("tape", F.floor(F.col("f") / 10).cast("int").alias("w")).agg(F.min_by("f", key).alias("frame"))


@query("level_change", "SELECT tape, f, level - lag(level) OVER (PARTITION BY tape ORDER BY f) AS change FROM levels")
def _(v):
    return v.levels.select("tape", "f", (F.col("level") - F.lag("level").over(Window.partitionBy("tape").orderBy("f"))).alias("change"))
