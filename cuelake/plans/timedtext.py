"""Timed-text queries: parsing, serialising, audit, timeline joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuelake.functions.timecode import srt_time, vtt_time
from cuelake.operators import intervals as I
from cuelake.operators import layout as L
from cuelake.operators import repair
from cuelake.plans.registry import query
from cuelake.sources import sinks, timedtext

_CLOCK = "lpad(CAST(CAST(floor({x} / 3600000) AS BIGINT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor({x} % 3600000 / 60000) AS BIGINT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor({x} % 60000 / 1000) AS BIGINT) AS VARCHAR), 2, '0') || '{p}' || lpad(CAST({x} % 1000 AS VARCHAR), 3, '0')"
_S, _E = _CLOCK.format(x="start_ms", p=","), _CLOCK.format(x="end_ms", p=",")


@query("cue_timecodes", f"SELECT doc, idx, {_S} AS srt_start, {_CLOCK.format(x='end_ms', p='.')} AS vtt_end FROM cues")
def _(v):
    return v.cues.select("doc", "idx", srt_time(F.col("start_s")).alias("srt_start"), vtt_time(F.col("end_s")).alias("vtt_end"))


_SRT = f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY idx) AS k FROM cues) SELECT doc, string_agg(CAST(k AS VARCHAR) || chr(10) || {_S} || ' --> ' || {_E} || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY idx) AS body FROM n GROUP BY doc"


@query("srt_documents", _SRT)
def _(v):
    return sinks.to_srt(v.cues, "doc", "idx", "start_s", "end_s", "text")


@query(
    "srt_round_trip",
    "SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY idx) - 1 AS INTEGER) AS pos, start_s AS \"start\", end_s AS \"end\", length(regexp_replace(text, '\\s', '', 'g')) AS chars FROM cues WHERE regexp_matches(text, '\\S')",
)
def _(v):
    bodies = sinks.to_srt(v.cues, "doc", "idx", "start_s", "end_s", "text")
    rows = timedtext.parse_srt(bodies, "body")
    return rows.select("doc", "pos", "start", "end", F.length(F.regexp_replace("text", r"\s", "")).cast("long").alias("chars"))


_ASS = "printf('%d:%02d:%05.2f', CAST(floor({0} / 3600) AS BIGINT), CAST(floor({0} % 3600 / 60) AS BIGINT), {0} % 60)"
_HEAD = "'" + sinks.ASS_HEAD.format(title="cues").replace("\n", "' || chr(10) || '") + "'"


@query(
    "ass_documents",
    f"SELECT doc, {_HEAD} || 'Format: Layer, Start, End, Text' || chr(10) || string_agg('Dialogue: 0,' || {_ASS.format('start_s')} || ',' || {_ASS.format('end_s')} || ',' || replace(text, chr(10), '\\N'), chr(10) ORDER BY idx) || chr(10) AS body FROM cues GROUP BY doc",
)
def _(v):
    return sinks.to_ass(v.cues, "doc", "idx", "start_s", "end_s", "text", "cues")


@query(
    "timed_lines",
    """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
t AS (SELECT doc_id, pos, trim(line) AS line FROM l WHERE trim(line) <> ''),
d AS (SELECT *, sum(greatest(2000, least(6000, CAST(floor(length(line) * 1000 / 12) AS BIGINT)))) OVER (PARTITION BY doc_id ORDER BY pos) AS ms FROM t)
SELECT doc_id, count(*) AS lines FROM d GROUP BY doc_id""",
)
def _(v):
    return timedtext.parse_timed_lines(v.documents.select("doc_id", "text"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("lines"))


@query("asr_segments", "SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY idx) - 1 AS INTEGER) AS pos, start_s AS \"start\", end_s AS \"end\", trim(text) AS text FROM cues WHERE trim(text) <> ''")
def _(v):
    by_ms = F.struct(F.transform("cs", lambda c: F.struct(F.struct(c.start_ms.alias("from"), c.end_ms.alias("to")).alias("offsets"), c.text.alias("text"))).alias("transcription"))
    by_s = F.struct(F.transform("cs", lambda c: F.struct((c.start_ms / 1000.0).alias("start"), (c.end_ms / 1000.0).alias("end"), c.text.alias("text"))).alias("segments"))
    docs = v.cues.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("idx", "start_ms", "end_ms", "text"))).alias("cs"))
    files = docs.select("doc", F.when(F.col("doc") % 2 == 0, F.to_json(by_ms)).otherwise(F.to_json(by_s)).alias("content"))
    return timedtext.parse_asr_json(files)


@query("cue_shift", "SELECT doc, idx, greatest(0, start_ms - 3500) AS start_ms, greatest(0, end_ms - 3500) AS end_ms FROM cues")
def _(v):
    late = lambda c: F.greatest(F.lit(0), F.col(c) - 3500).alias(c)
    return v.cues.select("doc", "idx", late("start_ms"), late("end_ms"))


@query("doc_duration", "SELECT doc, coalesce(max(end_s), 0) AS seconds FROM cues GROUP BY doc")
def _(v):
    return v.cues.groupBy("doc").agg(F.coalesce(F.max("end_s"), F.lit(0.0)).alias("seconds"))


@query("cue_widths", "SELECT doc, idx, length(replace(text, chr(10), '')) AS display_len, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS widest, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines FROM cues")
def _(v):
    return v.cues.select("doc", "idx", L.display_len(F.col("text")).cast("long").alias("display_len"), F.array_max(L.line_widths(F.col("text"))).cast("long").alias("widest"), F.size(F.split("text", "\n")).alias("n_lines"))


_FINDINGS = """
WITH c AS (SELECT *, lead(start_s) OVER (PARTITION BY doc ORDER BY idx) AS nxt, end_s - start_s AS dwell, length(replace(text, chr(10), '')) AS n,
  list_transform(string_split(text, chr(10)), lambda x: length(x)) AS widths FROM cues),
r AS (SELECT *, CASE WHEN end_s > start_s THEN n / dwell END AS rate, length(replace(trim(text), chr(10), '')) = 0 AS blank FROM c),
f AS (
SELECT doc, idx, 'empty' AS rule, 'major' AS severity FROM r WHERE blank
UNION ALL SELECT doc, idx, 'zero_span', 'major' FROM r WHERE NOT blank AND end_s <= start_s
UNION ALL SELECT doc, idx, 'fast', CASE WHEN rate > 17.0::DOUBLE * 1.4::DOUBLE + 0.05::DOUBLE THEN 'major' ELSE 'minor' END FROM r WHERE NOT blank AND rate > 17.05::DOUBLE
UNION ALL SELECT doc, idx, 'wide', 'major' FROM r WHERE NOT blank AND list_max(widths) > 42
UNION ALL SELECT doc, idx, 'tall', 'major' FROM r WHERE NOT blank AND len(widths) > 2
UNION ALL SELECT doc, idx, 'orphan', 'minor' FROM r WHERE NOT blank AND len(widths) = 2 AND list_min(widths) < 12
UNION ALL SELECT doc, idx, 'blink', 'major' FROM r WHERE NOT blank AND dwell < 0.8::DOUBLE - 0.002::DOUBLE
UNION ALL SELECT doc, idx, 'linger', 'minor' FROM r WHERE NOT blank AND dwell > 7.0::DOUBLE + 0.002::DOUBLE
UNION ALL SELECT doc, idx, 'clash', 'major' FROM r WHERE NOT blank AND end_s - nxt > 0.002::DOUBLE
UNION ALL SELECT doc, idx, 'bump', 'minor' FROM r WHERE NOT blank AND NOT (end_s - nxt > 0.002::DOUBLE) AND nxt - end_s < 0.08::DOUBLE - 0.002::DOUBLE)
"""


@query("layout_findings", _FINDINGS + "SELECT doc, idx, rule, severity FROM f")
def _(v):
    return L.findings(v.cues)


@query("layout_rules", _FINDINGS + "SELECT rule, count(*) AS n FROM f GROUP BY rule")
def _(v):
    return L.findings(v.cues).groupBy("rule").agg(F.count("*").alias("n"))


@query(
    "layout_audit",
    _FINDINGS
    + """, n AS (SELECT doc, count(*) FILTER (WHERE severity = 'major') AS major, count(*) FILTER (WHERE severity = 'minor') AS minor FROM f GROUP BY doc),
s AS (SELECT d.doc, d.cards, coalesce(n.major, 0) AS major, coalesce(n.minor, 0) AS minor, greatest(0.0::DOUBLE, 100.0::DOUBLE - coalesce(n.major, 0) * 9 - coalesce(n.minor, 0) * 2) AS score
  FROM (SELECT doc, count(*) AS cards FROM cues GROUP BY doc) d LEFT JOIN n ON n.doc = d.doc)
SELECT *, CASE WHEN score >= 95 THEN 'A' WHEN score >= 85 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM s""",
)
def _(v):
    return L.audit(v.cues)


@query("reading_rates", "SELECT doc, CAST(round(sum(end_ms - start_ms) * 1.0::DOUBLE / sum(length(replace(text, chr(10), ''))), 1) AS DOUBLE) AS ms_per_char FROM cues WHERE length(trim(text)) > 0 GROUP BY doc")
def _(v):
    live = v.cues.filter(F.length(F.trim("text")) > 0)
    return live.groupBy("doc").agg(F.round(F.sum(F.col("end_ms") - F.col("start_ms")) / F.sum(L.display_len(F.col("text"))), 1).alias("ms_per_char"))


# speakers' lines: runs of cues of one role, shifted by 1.3 s, so that they overlap cues of two runs
_LINES = """
WITH g AS (SELECT *, idx - row_number() OVER (PARTITION BY doc, role ORDER BY idx) AS run FROM cues),
l AS (SELECT doc, min(idx) AS line, role AS speaker, min(start_s) + 1.3::DOUBLE AS rs, max(end_s) + 1.3::DOUBLE AS re FROM g GROUP BY doc, role, run)
"""


def _lines(v):
    run = F.col("idx") - F.row_number().over(Window.partitionBy("doc", "role").orderBy("idx"))
    g = v.cues.withColumn("run", run).groupBy("doc", "role", "run")
    g = g.agg(F.min("idx").alias("line"), (F.min("start_s") + 1.3).alias("rs"), (F.max("end_s") + 1.3).alias("re"))
    return g.select("doc", "line", F.col("role").alias("speaker"), "rs", "re")


@query(
    "caption_speakers",
    _LINES
    + """, o AS (SELECT c.doc, c.idx, l.line, l.speaker, least(c.end_s, l.re) - greatest(c.start_s, l.rs) AS ov FROM cues c JOIN l ON l.doc = c.doc AND l.rs < c.end_s AND l.re > c.start_s),
b AS (SELECT *, row_number() OVER (PARTITION BY doc, idx ORDER BY ov DESC, line) AS r FROM o)
SELECT c.doc, c.idx, b.line, b.speaker FROM cues c LEFT JOIN b ON b.doc = c.doc AND b.idx = c.idx AND b.r = 1""",
)
def _(v):
    cues = v.cues.select("doc", "idx", F.col("start_s").alias("s"), F.col("end_s").alias("e"))
    lines = _lines(v)
    best = I.best_overlap(cues, lines.select("doc", "line", "rs", "re"), "doc", "idx", "line")
    return best.join(lines.select("doc", "line", "speaker"), ["doc", "line"], "left").select("doc", "idx", "line", "speaker")


@query(
    "overlap_pairs",
    _LINES + "SELECT c.doc, c.idx, l.line FROM cues c JOIN l ON l.doc = c.doc AND least(c.end_s, l.re) - greatest(c.start_s, l.rs) > 0",
)
def _(v):
    cues = v.cues.select("doc", "idx", F.col("start_s").alias("s"), F.col("end_s").alias("e"))
    return I.overlaps(cues, _lines(v).select("doc", "line", "rs", "re"), "doc").select("doc", "idx", "line")


@query(
    "cue_at_time",
    "SELECT p.doc, p.idx AS p, (SELECT min(c.idx) FROM cues c WHERE c.doc = p.doc AND c.start_ms <= p.start_ms + 700 AND p.start_ms + 700 <= c.end_ms) AS idx FROM cues p",
)
def _(v):
    points = v.cues.select("doc", F.col("idx").alias("p"), (F.col("start_ms") + 700).alias("t"))
    return I.latest_at(points, v.cues.select("doc", "idx", "start_ms", "end_ms"), "doc", "t", "start_ms", "end_ms", "idx").select("doc", "p", "idx")


@query(
    "dub_schedule",
    """
WITH RECURSIVE d AS (SELECT doc, idx, start_ms, 1000 + (length(text) * 97) % 7000 AS len, row_number() OVER (PARTITION BY doc ORDER BY idx) AS k FROM cues),
s AS (SELECT doc, idx, k, start_ms AS placed, start_ms + len AS head FROM d WHERE k = 1
  UNION ALL SELECT d.doc, d.idx, d.k, greatest(d.start_ms, s.head), greatest(d.start_ms, s.head) + d.len FROM d JOIN s ON d.doc = s.doc AND d.k = s.k + 1)
SELECT doc, idx, CAST(placed AS BIGINT) AS placed FROM s""",
)
def _(v):
    rows = v.cues.withColumn("len", 1000 + (F.length("text") * 97) % 7000)
    return I.packed_starts(rows, "doc", "idx", "start_ms", "len").select("doc", "idx", F.col("placed").cast("long").alias("placed"))


@query("cue_overlap_total", "SELECT doc, CAST(sum(greatest(0, coalesce(b - start_ms, 0))) AS BIGINT) AS overlap FROM (SELECT *, lag(end_ms + 250) OVER (PARTITION BY doc ORDER BY idx) AS b FROM cues) GROUP BY doc")
def _(v):
    rows = v.cues.withColumn("e", F.col("end_ms") + 250)
    return I.overlap_seconds(rows, "doc", "idx", "start_ms", "e").withColumn("overlap", F.coalesce("overlap", F.lit(0)))


@query("caption_preview", f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY idx) AS k, count(*) OVER (PARTITION BY doc) AS total FROM cues) SELECT doc, k AS row, total, {_S} || ' --> ' || {_E} || '  ' || substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 300) AS line FROM n WHERE k <= 60")
def _(v):
    w = Window.partitionBy("doc")
    rows = v.cues.withColumns({"row": F.row_number().over(w.orderBy("idx")).cast("long"), "total": F.count("*").over(w)}).filter("row <= 60")
    text = F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 300)
    return rows.select("doc", "row", "total", F.concat(srt_time(F.col("start_s")), F.lit(" --> "), srt_time(F.col("end_s")), F.lit("  "), text).alias("line"))


@query("segments_clamped", "SELECT doc, idx FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY idx) AS k FROM cues WHERE end_s > 0 AND start_s >= 0 AND start_s < end_s AND end_s <= 0.1 * 60 + 60) WHERE k <= 1500")
def _(v):
    rows = v.cues.filter((F.col("end_s") > 0) & (F.col("start_s") >= 0) & (F.col("start_s") < F.col("end_s")) & (F.col("end_s") <= 66.0))
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("doc").orderBy("idx"))).filter("k <= 1500").select("doc", "idx")


@query("transcripts", "SELECT doc, string_agg('[S' || CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END || '] ' || trim(coalesce(text, '')), chr(10) ORDER BY idx) AS body FROM cues GROUP BY doc")
def _(v):
    rows = v.cues.withColumn("sp", F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3))
    return sinks.transcript(rows, "doc", "idx", "sp", "text")


@query("speaker_summary", "SELECT doc, role, count(*) AS turns, CAST(sum(end_ms - start_ms) AS BIGINT) AS ms, CAST(sum(len(regexp_extract_all(text, '\\w+'))) AS BIGINT) AS words FROM cues GROUP BY doc, role")
def _(v):
    return v.cues.groupBy("doc", "role").agg(F.count("*").alias("turns"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"), F.sum(F.regexp_count("text", F.lit(r"\w+"))).alias("words"))


@query("speakers_relabelled", "WITH f AS (SELECT *, min(idx) OVER (PARTITION BY doc, role) AS first FROM cues) SELECT doc, idx, CAST(dense_rank() OVER (PARTITION BY doc ORDER BY first) AS INTEGER) AS speaker FROM f")
def _(v):
    rows = v.cues.withColumn("first", F.min("idx").over(Window.partitionBy("doc", "role")))
    return rows.select("doc", "idx", F.dense_rank().over(Window.partitionBy("doc").orderBy("first")).alias("speaker"))


@query("text_minutes", "SELECT doc_id, greatest(0.1::DOUBLE, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) / 150.0::DOUBLE) AS minutes FROM documents")
def _(v):
    n = F.regexp_count("text", F.lit(r"[^ \t\n\r\f\x0b]+"))
    return v.documents.select("doc_id", F.greatest(F.lit(0.1), n / F.lit(150.0)).alias("minutes"))


@query("layout_polished")
def _(v):
    return repair.polished(v.cues)


@query("words_kept", "SELECT doc, array_to_string(list_filter(regexp_split_to_array(string_agg(text, ' ' ORDER BY idx), '\\s+'), lambda x: x <> ''), ' ') AS words FROM cues GROUP BY doc")
def _(v):
    rows = repair.polished(v.cues).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("card", "text"))).alias("cs"))
    return rows.select("doc", F.trim(F.regexp_replace(F.array_join(F.transform("cs", lambda c: c.text), " "), r"\s+", " ")).alias("words"))
