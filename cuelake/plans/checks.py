"""Queries over checks and small rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.functions import checks as C
from cuelake.plans.registry import query


@query("media_sniffed", "SELECT page_id, ext, CASE ext WHEN '.wav' THEN html LIKE 'RIFF%' WHEN '.mp4' THEN substr(html, 5, 4) = 'ftyp' ELSE true END OR strlen(html) < 12 AS fits FROM (SELECT *, CASE page_id % 3 WHEN 0 THEN '.wav' WHEN 1 THEN '.mp4' ELSE '.txt' END AS ext FROM pages)")
def _(v):
    ext = F.when(F.col("page_id") % 3 == 0, ".wav").when(F.col("page_id") % 3 == 1, ".mp4").otherwise(".txt")
    return v.pages.withColumn("ext", ext).select("page_id", "ext", C.media_fits(F.col("html").cast("binary"), F.col("ext")).alias("fits"))


@query("listening_budget", "SELECT id, least(greatest(minutes, 0.1::DOUBLE) * 60 + 60, 3600.0::DOUBLE) AS want, greatest(minutes, 0.1::DOUBLE) * 60 AS paid, 1800 >= least(greatest(minutes, 0.1::DOUBLE) * 60 + 60, 3600.0::DOUBLE) - 0.5::DOUBLE AND 1800 < greatest(minutes, 0.1::DOUBLE) * 60 - 0.5::DOUBLE AS cut_short FROM jobs")
def _(v):
    rows = v.jobs.select("id", C.listening(F.col("minutes")).alias("l")).select("id", "l.*")
    return rows.withColumn("cut_short", C.cut_short(F.lit(1800), F.col("want"), F.col("paid")))


@query(
    "profile_windows",
    """
WITH b AS (SELECT doc, idx, CAST(floor(start_s * 8000) AS BIGINT) AS a, CAST(floor(end_s * 8000) AS BIGINT) AS e FROM cues),
s AS (SELECT doc, idx, a, e - a AS span, least(4, (e - a) // 8000) AS n FROM b),
k AS (SELECT *, unnest(range(0, CASE WHEN span <= 8000 THEN 1 ELSE n END)) AS k FROM s)
SELECT doc, idx, CAST(k AS INTEGER) AS k, CASE WHEN span <= 8000 THEN a ELSE a + (span - 8000) * k // greatest(1, n - 1) END AS a, CASE WHEN span <= 8000 THEN a + span ELSE a + (span - 8000) * k // greatest(1, n - 1) + 8000 END AS b FROM k""",
)
def _(v):
    exact = C.profile_spans(F.col("start_ms") / 1000, F.col("end_ms") / 1000)
    return v.cues.select("doc", "idx", F.explode(exact).alias("w")).select("doc", "idx", "w.*")


@query("cue_tags", "SELECT doc, idx, idx % 4 AS speaker, text FROM cues")
def _(v):
    tagged = F.concat(F.lit("[S"), (F.col("idx") % 4).cast("string"), F.lit("] "), F.col("text"))
    rows = v.cues.select("doc", "idx", C.cue_tag(tagged).alias("t"))
    return rows.select("doc", "idx", F.col("t.speaker").cast("long").alias("speaker"), F.col("t.text").alias("text"))


@query("voices_cast", "SELECT doc, idx, CASE role WHEN 'user' THEN ['u1', 'u2', 'u3'] ELSE ['r1', 'r2'] END[CASE WHEN idx > 0 THEN (idx - 1) % (CASE role WHEN 'user' THEN 3 ELSE 2 END) ELSE 0 END + 1] AS voice FROM cues")
def _(v):
    lang = F.when(F.col("role") == "user", "uz").otherwise("??")
    return v.cues.select("doc", "idx", C.voice_of({"uz": ["u1", "u2", "u3"], "ru": ["r1", "r2"]}, lang, F.col("idx").cast("int")).alias("voice"))


@query("props_numbers", "SELECT event_id, CASE WHEN try_cast(value AS DOUBLE) IS NULL THEN 0 ELSE value END AS value, event_type IN ('on', 'yes') AS yes FROM events")
def _(v):
    return v.events.select("event_id", C.finite(F.col("value").cast("string")).alias("value"), C.truthy(F.col("event_type")).alias("yes"))


@query("meta_merged", "SELECT id, CASE WHEN meta_json = '' THEN 'false' WHEN meta_json LIKE '%polish%' THEN 'done' ELSE 'false' END AS polish, 'x' AS added FROM jobs")
def _(v):
    base = F.coalesce(F.from_json("meta_json", "map<string,string>"), F.create_map().cast("map<string,string>"))
    patch = F.create_map(F.lit("added"), F.lit("x"))
    patch = F.when(F.contains("meta_json", F.lit("polish")), F.map_concat(patch, F.create_map(F.lit("polish"), F.lit("done")))).otherwise(patch)
    m = v.jobs.select("id", C.merged(base, patch).alias("m"))
    return m.select("id", F.coalesce(F.col("m")["polish"], F.lit("false")).alias("polish"), F.col("m")["added"].alias("added"))


@query("page_languages", "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'ru' WHEN 1 THEN 'en' ELSE 'uz' END AS lang, turn % 2 = 0 AS html FROM conversations")
def _(v):
    header = F.when(F.col("turn") % 4 == 0, "fr;q=0.1, ru-RU").when(F.col("turn") % 4 == 1, "EN").when(F.col("turn") % 4 == 2, "de")
    accept = F.when(F.col("turn") % 2 == 0, "text/html, */*").otherwise("application/json")
    return v.conversations.select("conv_id", "turn", C.page_language(header).alias("lang"), C.wants_html(accept).alias("html"))
