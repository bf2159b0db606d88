"""Checks of what a request sends, as column expressions: null, or the code of the first rule that refuses it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most characters of a text, of a cue and of a term; most terms, lines, cues and words; longest time, its slack.
TEXT_MOST, CUE_MOST, TERM_MOST = 5000, 300, 120
TERMS_MOST, LINES_MOST, CUES_MOST, WORDS_MOST, SEGMENTS_MOST = 100, 400, 2000, 8000, 1500
TIME_MOST, TIME_SLACK = 86_400.0, 0.001
#: Reach of a shift, sample rates, least samples.
SHIFT_LEAST, SHIFT_MOST, RATE_LEAST, RATE_MOST, SAMPLES_LEAST = 0.05, 2.0, 6_000, 192_000, 800
APOSTROPHES = "ʻ’`´ʼ"
_BLANK = r"(?U)^\s*$"


def first_of(*rules: tuple[Column, str]) -> Column:
    """The code of the first rule that holds; null if none does."""
    return reduce(lambda out, r: out.when(r[0], r[1]), rules[1:], F.when(*rules[0]))


def text_code(text: Column) -> Column:
    return first_of((text.isNull(), "not_text"), (text.rlike(_BLANK), "blank"), (F.length(text) > TEXT_MOST, "too_long"))


def term_kept(term: Column) -> Column:
    """A term as it is looked up: one apostrophe, no space at the ends, cut to its length; null if nothing is left."""
    one = F.translate(F.regexp_replace(term, r"(?U)^\s+|\s+$", ""), APOSTROPHES, "'" * len(APOSTROPHES))
    return F.nullif(F.substring(one, 1, TERM_MOST), F.lit(""))


def terms_checked(terms: DataFrame, key: str, src: str, tgt: str) -> DataFrame:
    """key, terms, code: how many terms of a request are kept (of like ones the last counts), or that there are too many. terms: key, src, tgt."""
    to = F.nullif(F.substring(F.regexp_replace(tgt, r"(?U)^\s+|\s+$", ""), 1, TERM_MOST), F.lit(""))
    rows = terms.select(key, F.col(src).alias("raw"), term_kept(F.col(src)).alias("s"), to.alias("t"))
    per = rows.groupBy(key).agg(F.count_distinct("raw").alias("sent"), F.count_distinct(F.when(F.col("t").isNotNull(), F.col("s"))).alias("kept"))
    many = F.col("sent") > TERMS_MOST
    return per.select(key, F.when(~many, F.col("kept")).alias("terms"), F.when(many, "too_many_terms").alias("code"))


def cue_text(text: Column) -> Column:
    """A cue's text cut to its length, for engines that may trim."""
    return F.substring(text, 1, CUE_MOST)


def cue_code(start: Column, end: Column, text: Column, strict: bool = True) -> Column:
    """Text is required; times are numbers within the day, the end not before the start; a strict engine refuses what it would have to cut."""
    inside = lambda t, low: (t >= low) & (t <= TIME_MOST)  # noqa: E731  false for NaN, which Spark counts as greatest
    fine = inside(start, F.lit(-TIME_SLACK)) & inside(end, start - TIME_SLACK)
    rules = [(text.isNull() | text.rlike(_BLANK), "text_required"), (start.isNull() | end.isNull(), "not_numbers"), (~fine, "impossible_timings")]
    return first_of(*rules, *[(F.length(text) > CUE_MOST, "text_too_long")] * strict)


def cues_checked(cues: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """Cues (key, idx, start, end, text) with code: a request with too many lines refuses all of them."""
    many = cues.groupBy(key).agg((F.count("*") > LINES_MOST).alias("_many"))
    code = F.when(F.col("_many"), "too_many_lines").otherwise(cue_code(F.col("start"), F.col("end"), F.col("text"), strict))
    rows = cues.join(many, key).withColumn("code", code).drop("_many")
    return rows.withColumns({"start": F.round("start", 3), "end": F.round("end", 3), "text": cue_text(F.col("text"))})


def one_shape(srt: Column, lines: Column) -> Column:
    """Exactly one of two shapes is sent."""
    has = lambda x: ~F.coalesce(x, F.lit("")).rlike(_BLANK)
    return F.when(has(srt) == has(lines), "one_of_two")


def rate_code(rate: Column) -> Column:
    return F.when(rate.isNull() | ~rate.between(RATE_LEAST, RATE_MOST), "bad_rate")


def align_code(cues: Column, shift: Column) -> Column:
    fine = shift.isNotNull() & ~F.isnan(shift) & shift.between(SHIFT_LEAST, SHIFT_MOST)
    return first_of((cues == 0, "no_cues"), (cues > CUES_MOST, "too_many_cues"), (~fine, "bad_shift"))


def words_code(cues: Column, words: Column, rate: Column, samples: Column) -> Column:
    """Null samples mean a tape that still arrives."""
    return first_of(
        (cues == 0, "no_cues"), (cues > CUES_MOST, "too_many_cues"), (words > WORDS_MOST, "too_many_words"), (rate_code(rate).isNotNull(), "bad_rate"),
        (F.coalesce(samples < SAMPLES_LEAST, F.lit(False)), "too_short"),
    )


def engine_open(enabled: Column) -> Column:
    """Only a flag that says false closes the engine; a missing one leaves it open."""
    return F.coalesce(enabled, F.lit(True))


def capped(segments: DataFrame, key: str, order: str, most: int = SEGMENTS_MOST) -> DataFrame:
    """The first segments of each key, in order."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    return segments.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def cut_list(items: Column, most: int) -> Column:
    """struct(items, cut): the first of a list, and whether some are left out."""
    return F.struct(F.slice(items, 1, most).alias("items"), (F.size(items) > most).alias("cut"))


def engines(meta: Column) -> Column:
    """struct(asr, demo, reason): what made a job's text, with defaults."""
    get = lambda k: F.nullif(F.get_json_object(meta, f"$.{k}"), F.lit(""))
    return F.struct(
        F.coalesce(get("asr_mode"), F.lit("unknown")).alias("asr"), F.coalesce(get("asr_demo").try_cast("boolean"), F.lit(False)).alias("demo"),
        F.coalesce(get("asr_reason"), F.lit("")).alias("reason"),
    )


#: Media types by extension; which of them are sound only.
MEDIA = {".wav": "audio/wav", ".mp3": "audio/mpeg", ".m4a": "audio/mp4", ".ogg": "audio/ogg", ".mp4": "video/mp4", ".mov": "video/quicktime"}
SOUND = (".wav", ".mp3", ".m4a", ".ogg")


def media(path: Column, size: Column) -> Column:
    """struct(kind, mime, bytes) by a path's extension; null for unknown ones and for empty files."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    mime = F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv])[ext]
    kind = F.when(ext.isin(*SOUND), "audio").otherwise("video")
    return F.when(mime.isNotNull() & (size > 0), F.struct(kind.alias("kind"), mime.alias("mime"), size.alias("bytes")))


#: Outward names of a job's files.
FILE_LABELS = {
    "transcript": "TXT", "srt": "SRT", "srt_bilingual": "SRT 2×", "ass": "ASS", "ass_karaoke": "ASS ♪", "dubbing": "WAV ♪", "document": "DOC", "diarization": "TURN",
    "align": "JIMLIK", "words": "SOʻZ", "layout": "QATOR",
}


def label_of(kind: Column, labels: dict[str, str] = FILE_LABELS) -> Column:
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(names[kind], F.upper(kind))


def iso_stamp(at: Column) -> Column:
    """A moment as text, in UTC, to the second."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def shared_words(text: Column, lexicon: list[str]) -> Column:
    """Words of a lexicon that a text holds, in order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}']+"), F.lit(0))
    return F.array_sort(F.array_intersect(words, F.array(*[F.lit(w) for w in lexicon])))
