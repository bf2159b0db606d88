"""Serialisers: cue rows to subtitle documents, one string per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions.timecode import ass_time, srt_time, vtt_time

#: Fixed value: the styled script's head.
ASS_HEAD = (
    "[Script Info]\nTitle: {title}\nScriptType: v4.00+\nPlayResX: 1280\nPlayResY: 720\n\n[V4+ Styles]\n"
    "Format: Name, Fontname, Fontsize, PrimaryColour, OutlineColour, Alignment\n"
    "Style: Default,Arial,42,&H00FFFFFF,&H00000000,2\n\n[Events]\n"
)


def _in_order(cues: DataFrame, key: str, order: str, **cols: Column) -> DataFrame:
    """key and cs, the document's cues in order."""
    row = F.struct(F.col(order).alias("_o"), *[c.alias(n) for n, c in cols.items()])
    return cues.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("cs"))


def to_srt(cues: DataFrame, key: str, order: str, start: str, end: str, text: str) -> DataFrame:
    """key, body: cues numbered from 1, each followed by a blank line."""
    rows = _in_order(cues, key, order, s=srt_time(F.col(start)), e=srt_time(F.col(end)), t=F.col(text))
    blocks = F.transform("cs", lambda c, i: F.concat((i + 1).cast("string"), F.lit("\n"), c.s, F.lit(" --> "), c.e, F.lit("\n"), F.coalesce(c.t, F.lit("")), F.lit("\n")))
    return rows.select(key, F.array_join(blocks, "\n").alias("body"))


def to_ass(cues: DataFrame, key: str, order: str, start: str, end: str, text: str, title: str) -> DataFrame:
    rows = _in_order(cues, key, order, s=ass_time(F.col(start)), e=ass_time(F.col(end)), t=F.replace(F.col(text), F.lit("\n"), F.lit("\\N")))
    events = F.transform("cs", lambda c: F.concat(F.lit("Dialogue: 0,"), c.s, F.lit(","), c.e, F.lit(","), c.t))
    head = ASS_HEAD.format(title=title) + "Format: Layer, Start, End, Text\n"
    return rows.select(key, F.concat(F.lit(head), F.array_join(events, "\n"), F.lit("\n")).alias("body"))


def words_to_vtt(cues: DataFrame, key: str, order: str, start: str, end: str, words: str) -> DataFrame:
    """words: array<struct<w,s,e>>; cues without words give nothing."""
    rows = _in_order(cues.filter(F.size(words) > 0), key, order, s=vtt_time(F.col(start)), e=vtt_time(F.col(end)), ws=F.transform(words, lambda w: F.concat(F.lit("<"), vtt_time(w.s), F.lit(">"), w.w)))
    blocks = F.transform("cs", lambda c: F.concat(c.s, F.lit(" --> "), c.e, F.lit("\n"), F.array_join(c.ws, " "), F.lit("\n")))
    return rows.select(key, F.concat(F.lit("WEBVTT\n\n"), F.array_join(blocks, "\n")).alias("body"))


def words_to_ass(cues: DataFrame, key: str, order: str, start: str, end: str, words: str, title: str) -> DataFrame:
    """Karaoke: each word's length in hundredths, at least one."""
    hundredths = lambda x: F.rint(x * 100).cast("long")

    def clock(x: Column) -> Column:
        cs = F.greatest(F.lit(0), hundredths(x))
        return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs % 360000 / 6000), F.floor(cs % 6000 / 100), cs % 100)

    def sung(w: Column, k: Column) -> Column:
        clean = F.translate(w.w, "\n\r{}", "  ()")
        return F.concat(F.when(k > 0, " ").otherwise(""), F.lit("{\\kf"), F.greatest(F.lit(1), hundredths(w.e - w.s)).cast("string"), F.lit("}"), clean)

    rows = _in_order(cues.filter(F.size(words) > 0), key, order, s=clock(F.col(start)), e=clock(F.col(end)), t=F.array_join(F.transform(words, sung), ""))
    events = F.transform("cs", lambda c: F.concat(F.lit("Dialogue: 0,"), c.s, F.lit(","), c.e, F.lit(",Default,,0,0,0,,"), c.t))
    head = ASS_HEAD.format(title=title) + "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Text\n"
    return rows.select(key, F.concat(F.lit(head), F.array_join(events, "\n"), F.lit("\n")).alias("body"))


def transcript(turns: DataFrame, key: str, order: str, speaker: str, text: str) -> DataFrame:
    rows = _in_order(turns, key, order, p=F.col(speaker), t=F.trim(F.coalesce(F.col(text), F.lit(""))))
    lines = F.transform("cs", lambda c: F.concat(F.lit("[S"), c.p.cast("string"), F.lit("] "), c.t))
    return rows.select(key, F.array_join(lines, "\n").alias("body"))
