"""Layout rules over cues: text measures, the audit and the two-line wrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The house style, and the slack that rounding needs.
MAX_CPS, MAX_CHARS, MAX_LINES, MIN_DWELL, MAX_DWELL, MIN_GAP, ORPHAN_MIN = 17.0, 42, 2, 0.8, 7.0, 0.08, 12
TIME_TOL, CPS_TOL = 0.002, 0.05
GRADES = ((95, "A"), (85, "B"), (70, "C"), (40, "D"))


def display_len(text: Column) -> Column:
    return F.length(F.replace(text, F.lit("\n"), F.lit("")))


def line_widths(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.length(x))


def reading_rate(text: Column, start: Column, end: Column) -> Column:
    """Characters a second, or null without a dwell."""
    return F.when(end > start, display_len(text) / (end - start))


def grade(score: Column) -> Column:
    out = F.lit("F")
    for least, name in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def findings(cues: DataFrame, key: str = "doc", order: str = "idx", start: str = "start_s", end: str = "end_s", text: str = "text", speaker: str | None = None) -> DataFrame:
    """One row per finding: key, order, rule, severity. The next cue is met by one window, whatever the number of rules."""
    w = Window.partitionBy(key).orderBy(order)
    s, e, t = F.col(start), F.col(end), F.coalesce(F.col(text), F.lit(""))
    rows = cues.withColumn("_next", F.lead(s).over(w))
    if speaker:
        rows = rows.withColumn("_voice", F.lead(speaker).over(w))
    dwell, nxt = e - s, F.col("_next")
    widths = line_widths(t)
    rate = reading_rate(t, s, e)
    rule = lambda name, when, major: F.when(when, F.struct(F.lit(name).alias("rule"), F.when(major, "major").otherwise("minor").alias("severity")))
    yes, no = F.lit(True), F.lit(False)
    empty = display_len(F.trim(t)) == 0
    rules = [
        rule("zero_span", e <= s, yes),
        rule("fast", rate > MAX_CPS + CPS_TOL, rate > MAX_CPS * 1.4 + CPS_TOL),
        rule("wide", F.array_max(widths) > MAX_CHARS, yes),
        rule("tall", F.size(widths) > MAX_LINES, yes),
        rule("orphan", (F.size(widths) == 2) & (F.array_min(widths) < ORPHAN_MIN), no),
        rule("blink", dwell < MIN_DWELL - TIME_TOL, yes),
        rule("linger", dwell > MAX_DWELL + TIME_TOL, no),
        rule("clash", e - nxt > TIME_TOL, yes),
        rule("bump", ~(e - nxt > TIME_TOL) & (nxt - e < MIN_GAP - TIME_TOL), no),
    ]
    if speaker:
        rules.append(rule("speaker_flash", (dwell < 1.0) & (F.col(speaker) != 0) & (F.col("_voice") != F.col(speaker)), no))
    found = F.when(empty, F.array(F.struct(F.lit("empty").alias("rule"), F.lit("major").alias("severity")))).otherwise(
        F.filter(F.array(*rules), lambda x: x.isNotNull())
    )
    return rows.select(key, order, F.explode(found).alias("f")).select(key, order, "f.rule", "f.severity")


def audit(cues: DataFrame, key: str = "doc", order: str = "idx", start: str = "start_s", end: str = "end_s", text: str = "text") -> DataFrame:
    """One row per document: cards, major, minor, score, grade."""
    found = findings(cues, key, order, start, end, text)
    n = found.groupBy(key).agg(F.count_if(F.col("severity") == "major").alias("major"), F.count_if(F.col("severity") == "minor").alias("minor"))
    rows = cues.groupBy(key).agg(F.count("*").alias("cards")).join(n, key, "left")
    rows = rows.withColumns({"major": F.coalesce("major", F.lit(0)), "minor": F.coalesce("minor", F.lit(0))})
    score = F.greatest(F.lit(0.0), F.lit(100.0) - F.col("major") * 9 - F.col("minor") * 2)
    return rows.withColumn("score", score).withColumn("grade", grade(F.col("score")))
