"""Speaker attribution, word timing, alignment and tapes in blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.functions.script import APOSTROPHES
from cuelake.operators import alignment, turns, words
from cuelake.operators import signal as S
from cuelake.plans.registry import query
from cuelake.plans.signal import gates_sql
from cuelake.session import shared_folder
from cuelake.sources import sinks, tapes
from cuelake.streaming import tape as T

#: The tapes of the check have 64 levels; at this frame they last as long as a conversation's cues.
FRAME_S = 0.5


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(map(q, items)) + "]"


_STEM = "CASE WHEN ends_with(w, 'mi') AND length(w) > 4 THEN w[:-3] ELSE w END"
_ENDS = lambda kinds: " OR ".join(f"ends_with({_STEM}, {q(e)})" for e in kinds)
#: The signs of Latin texts: the checking engine has no conversion from Cyrillic.
_SIGNS = f"""
WITH low AS (
  SELECT *, lower(nfc_normalize(translate(coalesce(text, ''), '{APOSTROPHES}', {q("'" * len(APOSTROPHES))}))) AS low, coalesce(text, '') AS raw FROM talk
), w AS (
  SELECT *, regexp_extract_all(low, {q(turns.WORD)}) AS words, trim(regexp_replace(low, {q(turns.NOT_WORD)}, ' ', 'g')) AS bare FROM low
), p AS (
  SELECT *, list_filter(list_transform(words, lambda w: CASE WHEN w IN ({", ".join(map(q, turns.NOT_VERBS))}) THEN 0 WHEN {_ENDS(turns.SECOND_ENDS)} THEN 2 WHEN {_ENDS(turns.FIRST_ENDS)} THEN 1 ELSE 0 END), lambda m: m > 0) AS said,
    list_has_any(words, {_list(turns.SECOND_ALL)}) AS second, list_has_any(words, {_list(turns.FIRST_ALL)}) AS first FROM w
), signs AS (
  SELECT doc, idx, start_s, end_s, regexp_matches(raw, {q(turns.BLANK)}) AS blank, regexp_matches(raw, {q(turns.ENDED)}) AS ended, regexp_matches(raw, {q(turns.RUNS_ON)}) AS runs_on,
    regexp_matches(low, {q(turns.opening(turns.GREETINGS))}) AS greets, regexp_matches(low, {q(turns.opening(turns.GREETING_REPLIES))}) AS greets_back,
    regexp_matches(bare, {q(turns.ANSWER)}) AND len(regexp_extract_all(bare, {q(turns.WORD)})) <= 3 AS answers, regexp_matches(low, {q(turns.opening(turns.FLOOR_TAKERS))}) AS takes_floor,
    regexp_matches(low, {q(turns.ASKS)}) AS asks, list_has_any(words, {_list(turns.ADDRESSES)}) OR regexp_matches(raw, {q(turns.NAMED)}) AS addresses,
    CAST(CASE WHEN len(said) > 0 THEN said[-1] WHEN second AND NOT first THEN 2 WHEN first AND NOT second THEN 1 ELSE 0 END AS INTEGER) AS person FROM p
)"""


def _evidence() -> str:
    """Each rule of the table once more, as SQL over the cue before (p), the cue (c) and the gap."""
    told = (
        ("gap < -0.05 AND -gap < greatest(c.end_s - c.start_s, 0)", "'overlap:' || printf('%.2f', -gap) || 's'", turns.OVERLAP, 0),
        ("gap >= 2.5", "'gap:' || printf('%.1f', gap) || 's'", turns.LONG_GAP, 0),
        ("c.blank OR gap <= 0.35::DOUBLE AND NOT p.ended AND c.runs_on", "'continuation'", turns.CONTINUES, 0),
        ("p.greets AND c.greets_back", "'reply-greeting'", turns.REPLY, 1),
        ("c.answers AND NOT p.answers", "'backchannel'", turns.BACKCHANNEL, 1),
        ("c.takes_floor AND NOT p.takes_floor", "'floor-taker'", turns.FLOOR, 1),
        ("p.asks <> c.asks", "'adjacency:role-flip'", turns.ROLE_FLIP, 1),
        ("c.addresses AND NOT p.addresses", "'vocative'", turns.ADDRESS, 1),
        ("p.person > 0 AND c.person > 0 AND p.person <> c.person", "'person:' || p.person || '>' || c.person", turns.PERSON, 2),
    )
    family = lambda n: ", ".join(f"CASE WHEN {when} THEN {{'by': {-abs(x)}::DOUBLE, 'k': {k}, 'name': {name}, 'weight': {x}::DOUBLE}} END" for k, (when, name, x, f) in enumerate(told) if f == n)
    lists = ", ".join(f"list_sort(list_filter([{family(n)}], lambda x: x IS NOT NULL)) AS f{n}" for n in range(3))
    worth = " + ".join(f"(coalesce(f{n}[1].weight, 0) + coalesce(f{n}[2].weight, 0) * 0.3::DOUBLE)" for n in range(3))
    return (
        _SIGNS
        + f""", c AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY idx) AS i FROM signs
), e AS (SELECT c.doc, c.idx, c.i, {lists} FROM (SELECT c.*, c.start_s - p.end_s AS gap, p AS before FROM c LEFT JOIN c AS p ON p.doc = c.doc AND p.i = c.i - 1) AS c, (SELECT c.before AS p) AS b
), score AS (SELECT doc, idx, i, CASE WHEN i = 1 THEN 0 ELSE {worth} END AS score, CASE WHEN i = 1 THEN []::VARCHAR[] ELSE list_transform(list_concat(list_concat(f0, f1), f2), lambda x: x.name) END AS cues FROM e)"""
    )


_SCORES = _evidence()
_WHO = (
    _SCORES.replace("WITH ", "WITH RECURSIVE ", 1).replace("\nWITH", "WITH", 1)
    + """, t(doc, i, now, before, run, known, was) AS (
  SELECT doc, i, 1, 0, 1, 1, 0 FROM score WHERE i = 1
  UNION ALL
  SELECT doc, i, who, CASE WHEN who <> now THEN now ELSE before END, CASE WHEN who <> now THEN 1 ELSE run + 1 END, greatest(known, who), now FROM (
    SELECT *, CASE WHEN score <= -1.6::DOUBLE THEN now WHEN score >= 0.85::DOUBLE THEN CASE WHEN score < 1.3::DOUBLE THEN coalesce(other, fresh, now) ELSE coalesce(fresh, other, now) END
      WHEN score >= 0.55::DOUBLE AND known > 1 THEN coalesce(other, now) ELSE now END AS who
    FROM (SELECT s.doc, s.i, s.score, t.now, t.before, t.run, t.known, CASE WHEN t.before > 0 AND t.run < 12 THEN t.before END AS other, CASE WHEN t.known < 8 THEN t.known + 1 END AS fresh
      FROM t JOIN score AS s ON s.doc = t.doc AND s.i = t.i + 1) AS x) AS y
), who AS (SELECT s.doc, s.idx, CAST(t.now AS INTEGER) AS speaker, round(s.score, 3) AS score, s.cues,
  CASE WHEN s.i = 1 THEN 0::DOUBLE ELSE round(greatest(0, least(1, 0.5::DOUBLE + abs(s.score - CASE WHEN t.now <> t.was THEN 0.85::DOUBLE ELSE 0 END) / 2.5)), 2) END AS confidence
  FROM score AS s JOIN t ON t.doc = s.doc AND t.i = s.i)"""
)


@query("cue_signs", _SIGNS + " SELECT doc, idx, blank, ended, runs_on, greets, greets_back, answers, takes_floor, asks, addresses, person FROM signs")
def _(v):
    return turns.signs(v.talk).select("doc", "idx", *turns.SIGNS)


@query("cue_evidence", _SCORES + " SELECT doc, idx, round(score, 6) AS score, cues FROM score")
def _(v):
    found = turns.scored(turns.signs(v.talk), "doc", "idx", "start_s", "end_s")
    return found.select("doc", "idx", F.round("score", 6).alias("score"), "cues")


@query("cue_speakers", _WHO + " SELECT doc, idx, speaker, score, cues, confidence FROM who")
def _(v):
    return turns.speakers(v.talk)


@query(
    "speaker_totals",
    _WHO + """ SELECT who.doc, speaker, count(*) AS turns, CAST(sum(round((talk.end_s - talk.start_s) * 1000)) AS BIGINT) AS ms FROM who JOIN talk ON talk.doc = who.doc AND talk.idx = who.idx GROUP BY who.doc, speaker""",
)
def _(v):
    rows = turns.speakers(v.talk).select("doc", "idx", "speaker").join(v.talk, ["doc", "idx"])
    ms = F.round((F.col("end_s") - F.col("start_s")) * 1000).cast("long")
    return rows.groupBy("doc", "speaker").agg(F.count("*").alias("turns"), F.sum(ms).alias("ms"))


def _tape_cues(v):
    return v.cues.select(F.col("doc").alias("tape"), "idx", F.col("start_s").alias("s"), F.col("end_s").alias("e"), "text")


def _timed(v):
    return words.words_timed(_tape_cues(v), v.levels, S.gates(v.levels), FRAME_S)


@query(
    "word_cuts_asked",
    rf"""
WITH d AS (SELECT tape, count(*) AS frames FROM levels GROUP BY tape),
t AS (SELECT c.doc AS tape, c.idx, c.start_s AS s, c.end_s AS e, d.frames, d.frames * 0.5::DOUBLE AS duration,
  list_filter(regexp_extract_all(coalesce(text, ''), '[^\s\p{{Z}}]+'), lambda w: NOT regexp_matches(w, {q(words.TAG)}) AND regexp_matches(w, {q(words.SOUNDS)})) AS words
  FROM cues AS c JOIN d ON d.tape = c.doc),
f AS (SELECT *, len(words) AS n, CAST(greatest(0, least(frames - 1, floor(s / 0.5::DOUBLE))) AS INTEGER) AS f0 FROM t),
g AS (SELECT *, CAST(greatest(f0, least(frames - 1, ceil(e / 0.5::DOUBLE) - 1)) AS INTEGER) AS f1,
  list_transform(words, lambda w: greatest(len(regexp_extract_all(w, {q(words.SYLLABLE)})), 1) + 0.04::DOUBLE * greatest(length(w) - 1, 0)) AS weights FROM f),
r AS (SELECT *, CASE WHEN n = 0 THEN 'no_text' WHEN s >= duration OR e <= 0 THEN 'outside_audio' WHEN e - s < 0.06::DOUBLE * n THEN 'too_fast' WHEN n > 1 AND f1 + 1 - f0 < n THEN 'too_short' END AS reason FROM g),
a AS (SELECT *, CASE WHEN reason IS NULL THEN list_transform(range(1, n), lambda k: CAST(round_even(f0 + (f1 + 1 - f0) * (list_reduce(weights[1:k], lambda x, y: x + y) / list_reduce(weights, lambda x, y: x + y)), 0) AS INTEGER) - (k - 1)) ELSE [] END AS free FROM r)
SELECT tape, idx, words, list_transform(range(1, len(free) + 1), lambda k: CAST((k - 1) + least(f1 + 1 - (n - 1), greatest(f0 + 1, list_max(free[1:k]))) AS INTEGER)) AS cuts, reason FROM a""",
)
def _(v):
    return words.asked(_tape_cues(v), S.gates(v.levels), FRAME_S).select("tape", "idx", "words", "cuts", "reason")


@query("words_timed")
def _(v):
    return _timed(v)


@query("words_vtt")
def _(v):
    cues = v.cues.select(F.col("doc").alias("tape"), "idx", "start_s", "end_s")
    return sinks.words_to_vtt(_timed(v).join(cues, ["tape", "idx"]), "tape", "idx", "start_s", "end_s", "words")


@query("word_cut_methods")
def _(v):
    return _timed(v).select(F.explode("methods").alias("method")).groupBy("method").agg(F.count("*").alias("n"))


@query("cues_aligned")
def _(v):
    gate = S.gates(v.levels)
    quiet = S.pauses(S.speech_runs(v.levels, gate), gate, FRAME_S)
    return alignment.aligned(_tape_cues(v).drop("text"), quiet, gate, FRAME_S)


def _blocks(v):
    """The check's tapes: texts read as samples, in blocks of 64 bytes cut at odd places."""
    raw = F.encode("text", "UTF-8")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.octet_length("text") - 1, F.lit(0)), F.lit(4097)), lambda at: F.struct(at.cast("long").alias("at"), F.substring(raw, at + 1, F.lit(4097)).alias("bytes")))
    chunks = v.documents.filter("text IS NOT NULL").select(F.col("doc_id").alias("tape"), F.inline(cut))
    return T.whole_samples(chunks)


#: Bytes of a text as whole numbers, and the energies and levels of frames of 160 samples made of them.
_BYTES = "list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda h: CAST('0x' || h AS INTEGER))"
_FRAMES = """
s AS (SELECT tape, i // 160 AS f, b[2 * i + 1] + 256 * b[2 * i + 2] AS u FROM (SELECT tape, b, unnest(range(len(b) // 2)) AS i FROM b)),
e AS (SELECT tape, f, sum((CASE WHEN u > 32767 THEN u - 65536 ELSE u END) ** 2) AS energy, count(*) AS n FROM s GROUP BY tape, f),
lv AS (SELECT tape, CAST(f AS INTEGER) AS f, sqrt(energy / 160) / 32768 AS level FROM e WHERE n = 160)"""


@query("tape_levels", f"WITH b AS (SELECT doc_id AS tape, {_BYTES.format('text')} AS b FROM documents WHERE text IS NOT NULL), {_FRAMES} SELECT tape, f, level FROM lv")
def _(v):
    return T.levels(_blocks(v), 160)


@query(
    "tape_heard",
    """
WITH n AS (SELECT doc_id AS tape, least(strlen(text) // 2, CAST(floor(least(greatest(doc_id % 3 / 2000.0::DOUBLE, 0.1::DOUBLE) * 60 + 60, 3600.0::DOUBLE) * 8000) AS BIGINT)) AS n FROM documents WHERE text IS NOT NULL)
SELECT tape, round(n / 8000.0::DOUBLE, 3) AS heard_s, 6.0::DOUBLE AS paid_s, 66.0::DOUBLE AS reach_s, CASE WHEN n < 800 THEN 'too_short' END AS code, false AS cut_short FROM n WHERE n > 0""",
)
def _(v):
    tapes = v.documents.select(F.col("doc_id").alias("tape"), (F.col("doc_id") % 3 / 2000.0).alias("minutes"))
    return T.heard(_blocks(v), tapes)


@query(
    "tape_voices",
    f"""
WITH b AS (SELECT doc_id AS tape, {_BYTES.format('text')} AS b FROM documents WHERE text IS NOT NULL),
w AS (SELECT tape, b, unnest([0, 1, 2, 3]) AS idx FROM b),
x AS (SELECT tape, idx, list_transform(range(70), lambda i: b[300 * idx + 4 * i + 1] + 256 * b[300 * idx + 4 * i + 2]) AS u FROM w WHERE len(b) // 2 >= 150 * idx + 140),
y AS (SELECT tape, idx, list_transform(u, lambda v: CASE WHEN v > 32767 THEN v - 65536 ELSE v END) AS x FROM x),
e AS (SELECT tape, idx, x, list_sum(list_transform(x, lambda v: CAST(v AS BIGINT) * v)) / 70 AS energy, list_transform(range(1, 70), lambda i: x[i + 1] - x[i]) AS steps,
  len(list_filter(range(1, 70), lambda i: (x[i + 1] < 0) <> (x[i] < 0))) AS turns FROM y)
SELECT w.tape, CAST(w.idx AS BIGINT) AS idx, CASE WHEN e.energy > 0 THEN [round_even(sqrt(energy) / 32768, 4), round_even(turns / 69, 4), round_even(sqrt(list_sum(list_transform(steps, lambda v: CAST(v AS BIGINT) * v)) / 69 / energy), 4)] END AS voice
FROM w LEFT JOIN e ON e.tape = w.tape AND e.idx = w.idx""",
)
def _(v):
    cues = v.documents.filter("text IS NOT NULL").select(F.col("doc_id").alias("tape"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("idx"))
    windows = cues.select("tape", "idx", F.lit(0).alias("k"), (F.col("idx") * 150).cast("long").alias("a"), (F.col("idx") * 150 + 140).cast("long").alias("b"))
    return T.voices(_blocks(v), windows)


#: Texts of fifty documents, one after another, as a tape's samples.
_TAPES = f"""
WITH lying AS (SELECT CAST(floor(coalesce(doc_id, -1) / 50.0::DOUBLE) AS BIGINT) AS tape, doc_id, text FROM documents WHERE text IS NOT NULL),
b AS (SELECT tape, {_BYTES.format("string_agg(text, '' ORDER BY doc_id, text)")} AS b FROM lying GROUP BY tape)"""


def _laid(v) -> str:
    """The folder of the check's tapes, written by the tape sink."""
    folder = shared_folder(v.spark, "tapes")
    tapes.register(v.spark)
    at = F.coalesce("doc_id", F.lit(-1))
    chunks = v.documents.filter("text IS NOT NULL").select(F.floor(at / 50).alias("tape"), at.alias("at"), F.encode("text", "UTF-8").alias("bytes"))
    chunks.repartitionByRange("tape", "at").sortWithinPartitions("tape", "at", "bytes").write.format("tape").mode("append").save(folder)
    return folder


@query(
    "tape_blocks",
    _TAPES + " SELECT tape, CAST(k AS BIGINT) AS block, k * 1000 AS base, CAST(2 * least(1000, len(b) // 2 - k * 1000) AS INTEGER) AS bytes, upper(to_hex(b[2000 * k + 1])) AS first FROM (SELECT tape, b, unnest(range((len(b) // 2 + 999) // 1000)) AS k FROM b)",
)
def _(v):
    rows = v.spark.read.format("tape").option("block", 1000).load(_laid(v))
    return rows.select("tape", "block", "base", F.octet_length("pcm").alias("bytes"), F.ltrim(F.hex(F.substring("pcm", 1, 1)), F.lit("0")).alias("first"))


@query(
    "tape_curves",
    _TAPES + ", " + _FRAMES + ", " + gates_sql("lv").strip()[5:] + """
SELECT tape, frames, frames * 0.02::DOUBLE AS seconds, round(noise_floor, 9) AS noise_floor, round(gate_db, 6) AS gate_db, round(tape_db, 6) AS tape_db, silent FROM h""",
)
def _(v):
    """Taken in as a stream of blocks, asked when it has ended."""
    folder, store = _laid(v), shared_folder(v.spark, "levels")
    blocks = v.spark.readStream.format("tape").option("block", 1000).load(folder)
    tapes.end(folder)
    T.collecting(blocks, 160, f"{store}/parts", f"{store}/checkpoint").awaitTermination()
    found = T.curve(T.collected(v.spark, f"{store}/parts", 160), 160)
    return found.select("tape", "frames", "seconds", F.round("noise_floor", 9).alias("noise_floor"), F.round("gate_db", 6).alias("gate_db"), F.round("tape_db", 6).alias("tape_db"), "silent")
