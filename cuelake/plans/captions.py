"""Captions put together, shared previews and requests that are subtitle files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuelake.operators import captions as C
from cuelake.plans.registry import query
from cuelake.plans.timedtext import _E, _S
from cuelake.sources import sinks

#: Lower caps than a page's own, so that documents of the check reach them.
CUES, WORDS = 5, 60

_TAGGED = "CASE idx % 3 WHEN 0 THEN '[S' || CAST(doc % 3 AS INT) || '] ' || text ELSE text END"
_BASE = f"""
WITH c AS (SELECT doc, idx, {_TAGGED} AS text, text AS raw, start_s, end_s, start_ms, end_ms, role, row_number() OVER (PARTITION BY doc ORDER BY idx) AS n, count(*) OVER (PARTITION BY doc) AS total FROM cues),
t AS (SELECT *, try_cast(nullif(regexp_extract(coalesce(text, ''), '^\\[S(\\d+)\\]\\s*', 1), '') AS INTEGER) AS tagged, regexp_replace(coalesce(text, ''), '^\\[S(\\d+)\\]\\s*', '') AS said FROM c)"""


def _cues(v):
    return v.cues.select("doc", "idx", F.col("start_s").alias("start"), F.col("end_s").alias("end"), F.expr(_TAGGED).alias("text"))


def _assembled(v):
    n = F.row_number().over(Window.partitionBy("doc").orderBy("idx"))
    tokens = F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0))
    words = v.cues.select("doc", n.alias("i"), F.transform(tokens, lambda w: F.struct(w.alias("w"), F.col("start_s").alias("s"), F.col("end_s").alias("e"))).alias("words"))
    number = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3)
    lines = v.cues.select("doc", F.col("idx").alias("line"), number.alias("speaker"), (F.col("start_s") + 1.3).alias("rs"), (F.col("end_s") + 1.3).alias("re"))
    return C.assembled(_cues(v), words, lines, CUES, WORDS)


_CAPTIONS = (
    _BASE
    + f""", w AS (SELECT *, regexp_extract_all(raw, '\\S+') AS ws FROM t WHERE n <= {CUES}),
a AS (SELECT *, coalesce(sum(len(ws)) OVER (PARTITION BY doc ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM w),
l AS (SELECT doc, idx AS line, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS speaker, start_s + 1.3::DOUBLE AS rs, end_s + 1.3::DOUBLE AS re FROM cues),
o AS (SELECT a.doc, a.n, arg_min(l.speaker, (-(least(round(a.end_s, 3), l.re) - greatest(round(a.start_s, 3), l.rs)), l.line)) AS speaker FROM a JOIN l ON l.doc = a.doc AND l.rs < round(a.end_s, 3) AND l.re > round(a.start_s, 3) GROUP BY a.doc, a.n),
f AS (SELECT a.doc, a.n, round(a.start_s, 3) AS "start", round(a.end_s, 3) AS "end", substr(a.said, 1, 600) AS text, coalesce(a.tagged, o.speaker) AS speaker,
  list_transform(ws[1:greatest(0, least(len(ws), {WORDS} - ahead))], lambda x: substr(x, 1, 120)) AS words, a.total,
  a.total > {CUES} OR bool_or(ahead >= {WORDS} OR ahead + len(ws) > {WORDS}) OVER (PARTITION BY a.doc ORDER BY a.n) AS truncated FROM a LEFT JOIN o ON o.doc = a.doc AND o.n = a.n)"""
)


@query("captions_assembled", _CAPTIONS + " SELECT doc, CAST(n AS INTEGER) AS n, \"start\", \"end\", text, speaker, array_to_string(words, ' ') AS words, total, truncated FROM f")
def _(v):
    return _assembled(v).withColumn("words", F.array_join("words.w", " "))


@query("captions_summed", _CAPTIONS + " SELECT doc, count(*) AS count, max(total) AS total, CAST(sum(len(words)) AS BIGINT) AS words, sum(len(words)) > 0 AS karaoke, bool_or(speaker IS NOT NULL) AS speakers, bool_or(truncated) AS truncated FROM f GROUP BY doc")
def _(v):
    return C.summed(_assembled(v))


@query(
    "share_previews",
    _BASE + f""" SELECT doc, CAST(n AS INTEGER) AS n, total, {_S} || ' --> ' || {_E} || '  ' || substr(CASE WHEN tagged > 0 THEN '[S' || tagged || '] ' ELSE '' END || trim(regexp_replace(said, '\\s+', ' ', 'g')), 1, 300) AS line FROM t WHERE n <= 60""",
)
def _(v):
    return C.previews(_cues(v))


@query(
    "srt_requests",
    f"""
WITH n AS (SELECT *, CASE WHEN doc % 7 = 3 AND idx = 2 THEN 90000000 ELSE end_ms END AS late, row_number() OVER (PARTITION BY doc ORDER BY idx) AS k FROM cues),
b AS (SELECT doc, string_agg(CAST(k AS VARCHAR) || chr(10) || {_S} || ' --> ' || {_E.replace("end_ms", "late")} || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY idx) AS body, min(k) FILTER (WHERE late > 86400000) AS bad,
  min(k) FILTER (WHERE length(list_aggregate(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), 'string_agg', chr(10))) > 300) AS long FROM n GROUP BY doc)
SELECT doc, CASE WHEN length(body) > 5000 THEN 'srt_too_long' WHEN bad IS NOT NULL THEN 'bad_timing' WHEN long IS NOT NULL THEN 'text_too_long' END AS code,
  CAST(CASE WHEN length(body) > 5000 THEN NULL WHEN bad IS NOT NULL THEN bad ELSE long END AS INTEGER) AS at FROM b""",
)
def _(v):
    late = F.when((F.col("doc") % 7 == 3) & (F.col("idx") == 2), 90_000.0).otherwise(F.col("end_s"))
    files = sinks.to_srt(v.cues.withColumn("end_s", late), "doc", "idx", "start_s", "end_s", "text")
    return files.select("doc", C.requested(F.col("body")).alias("r")).select("doc", "r.code", "r.at")
