"""Dubbing: schedules reported, voices mixed in blocks, stand-in tones as WAV files."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.operators import dubbing as D
from cuelake.plans.registry import query

#: Samples between the lines of the check's tapes, and of a block.
STEP, BLOCK, RATE = 300, 1000, 8000


@query(
    "dub_report",
    """
WITH RECURSIVE d AS (SELECT doc, idx, start_s AS s, end_s AS e, (500 + (length(text) * 97) % 9000) / 1000.0::DOUBLE AS len, row_number() OVER (PARTITION BY doc ORDER BY idx) AS k FROM cues),
p AS (SELECT doc, k, s, e, len, s AS placed FROM d WHERE k = 1
  UNION ALL SELECT d.doc, d.k, d.s, d.e, d.len, greatest(d.s, p.placed + p.len) FROM d JOIN p ON d.doc = p.doc AND d.k = p.k + 1),
t AS (SELECT doc, count(*) AS lines, max(e) AS last, greatest(max(placed + len), max(e), 1) AS wanted, max(placed + len - e) AS drift, count(*) FILTER (WHERE placed > s + 0.000001::DOUBLE) AS shifted FROM p GROUP BY doc)
SELECT doc, lines, shifted, wanted > least(last * 2 + 60, 900) AS clipped, round(drift, 3) AS drift_sec, round(least(wanted, last * 2 + 60, 900), 3) AS total_sec FROM t""",
)
def _(v):
    lines = v.cues.withColumn("len", (500 + (F.length("text") * 97) % 9000) / 1000.0)
    return D.report(D.scheduled(lines, "doc", "idx", "start_s", "end_s", "len"), "doc", "start_s", "end_s", "len")


@query(
    "dub_mixed",
    f"""
WITH b AS (SELECT doc AS tape, idx AS line, idx * {STEP} AS begins, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS INTEGER)) AS b FROM cues WHERE text IS NOT NULL),
t AS (SELECT tape, max(begins) + {STEP + 17} AS samples FROM b GROUP BY tape),
s AS (SELECT tape, line, begins + i AS pos, b[2 * i + 1] + 256 * b[2 * i + 2] AS u FROM (SELECT *, unnest(range(len(b) // 2)) AS i FROM b)),
m AS (SELECT tape, pos, list_reduce(list_prepend(0, list(CASE WHEN u > 32767 THEN u - 65536 ELSE u END ORDER BY line)), lambda a, x: greatest(-32768, least(32767, a + x))) AS x FROM s GROUP BY tape, pos),
a AS (SELECT t.tape, p.pos, coalesce(m.x, 0) AS x FROM (SELECT tape, unnest(range(samples)) AS pos FROM t) AS p JOIN t ON t.tape = p.tape LEFT JOIN m ON m.tape = p.tape AND m.pos = p.pos)
SELECT tape, CAST(pos // {BLOCK} AS BIGINT) AS block, md5(unhex(string_agg(printf('%02X%02X', (x & 65535) & 255, (x & 65535) >> 8), '' ORDER BY pos))) AS md5 FROM a GROUP BY ALL""",
)
def _(v):
    voices = v.cues.filter("text IS NOT NULL").select(F.col("doc").alias("tape"), F.col("idx").alias("line"), (F.col("idx") * STEP).alias("at"), F.encode("text", "UTF-8").alias("pcm"))
    totals = voices.groupBy("tape").agg((F.max("at") + STEP + 17).alias("samples"))
    return D.mixed(voices, totals, BLOCK).select("tape", "block", F.md5("pcm").alias("md5"))


@query(
    "tone_wavs",
    f"""
WITH d AS (SELECT doc, idx, CASE WHEN idx % 2 = 0 THEN 220.0::DOUBLE ELSE 180.0::DOUBLE END AS base, greatest(0.3::DOUBLE, least((end_s - start_s) / 8, 30)) AS dur FROM cues),
s AS (SELECT doc, idx, list_transform(range(CAST(floor({RATE} * dur) AS BIGINT)), lambda i: CAST(trunc(12000 * sin(pi() * least(1.0::DOUBLE, i / {RATE}.0::DOUBLE / dur))
  * sin(2 * pi() * (base + 40 * sin(2 * pi() * 1.7::DOUBLE * (i / {RATE}.0::DOUBLE))) * (i / {RATE}.0::DOUBLE))) AS INTEGER) & 65535) AS x FROM d),
w AS (SELECT doc, idx, len(x) AS n, list_transform([len(x) * 2 + 36, len(x) * 2], lambda n: printf('%02X%02X%02X%02X', n & 255, (n >> 8) & 255, (n >> 16) & 255, n >> 24)) AS sizes,
  array_to_string(list_transform(x, lambda u: printf('%02X%02X', u & 255, u >> 8)), '') AS data FROM s)
SELECT doc, idx, n AS samples, md5(unhex('52494646' || sizes[1] || '57415645666D74201000000001000100401F0000803E00000200100064617461' || sizes[2] || data)) AS md5 FROM w""",
)
def _(v):
    rows = v.cues.select("doc", "idx", "start_s", "end_s")
    files = D.tone_files(rows, (F.col("end_s") - F.col("start_s")) / 8, F.when(F.col("idx") % 2 == 0, "uz").otherwise("ru"), RATE)
    return files.select("doc", "idx", "samples", F.md5("wav").alias("md5"))
