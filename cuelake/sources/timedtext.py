"""Timed-text sources: subtitle files, plain timed lines and recogniser JSON as cue rows.

Everything is parsed inside the row with array functions, so a file never shuffles; one explode gives the cues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions.timecode import TIMECODE, parse_time

CUES = "array<struct<idx:int,start:double,end:double,text:string>>"


def srt_cues(content: Column) -> Column:
    """The cues of a subtitle text, as an array.

    Blocks are parted by blank lines. A block counts if one of its first two non-blank lines has exactly two
    timecodes (the first of the two with any decides); its number is line one when that is digits and the times are
    on line two, otherwise its place among the blocks that count.
    """
    blank = lambda x: F.trim(F.translate(x, "\t\r\x0b\x0c", "    ")) != ""
    lines = lambda b: F.filter(F.split(b, r"\r\n|\n|\r"), blank)
    blocks = F.transform(F.split(F.btrim(content, F.lit(" \t\r\n")), r"\n\s*\n"), lines)

    def shape(ls: Column) -> Column:
        on_first = F.size(ls).__ge__(1) & F.get(ls, F.lit(0)).rlike(TIMECODE)
        on_second = F.size(ls).__ge__(2) & F.get(ls, F.lit(1)).rlike(TIMECODE)
        at = F.when(on_first, 0).when(on_second, 1)
        times = F.regexp_extract_all(F.get(ls, at), F.lit(f"({TIMECODE})"), F.lit(1))
        return F.struct(ls.alias("ls"), at.alias("at"), times.alias("times"))

    counted = F.filter(F.transform(blocks, shape), lambda b: F.size(b.times) == 2)

    def cue(b: Column, i: Column) -> Column:
        named = (b["at"] == 1) & F.trim(F.get(b.ls, F.lit(0))).rlike(r"^\d+$")
        number = F.when(named, F.trim(F.get(b.ls, F.lit(0))).try_cast("int")).otherwise(i + 1)
        text = F.array_join(F.slice(b.ls, b["at"] + 2, F.size(b.ls)), "\n")
        return F.struct(
            number.alias("idx"), parse_time(F.get(b.times, F.lit(0))).alias("start"), parse_time(F.get(b.times, F.lit(1))).alias("end"), text.alias("text")
        )

    return F.transform(counted, cue)


def parse_srt(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per cue: the file's other columns, pos (from 0), idx, start, end, text. A file without cues gives none."""
    others = [c for c in files.columns if c != content]
    return files.select(*others, F.posexplode(srt_cues(F.col(content))).alias("pos", "cue")).select(*others, "pos", "cue.*")


def parse_timed_lines(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """Plain lines as segments: key, pos, start, end, text.

    ``a-b|text`` (or ``a--b|text``) is timed by hand and moves the clock to b; any other line lasts a twelfth of a second a
    character, between 2 and 6 seconds, from where the clock stands.
    """
    line = files.select(key, F.posexplode(F.split(content, r"\r\n|\n|\r")).alias("pos", "line")).withColumn("line", F.trim("line"))
    hand = r"^\s*([0-9.]+)\s*--?\s*([0-9.]+)\s*\|(.*)$"
    a, b = (F.regexp_extract("line", hand, k).try_cast("double") for k in (1, 2))
    dur = F.greatest(F.lit(2.0), F.least(F.lit(6.0), F.length("line") / F.lit(12.0)))
    rows = line.filter("line <> ''").withColumns({"a": a, "b": b, "dur": dur})
    rows = rows.withColumn("by_hand", F.col("a").isNotNull() & F.col("b").isNotNull())
    order = Window.partitionBy(key).orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("stretch", F.count_if(F.col("by_hand")).over(upto)).withColumn("base", F.last(F.when(F.col("by_hand"), F.col("b")), ignorenulls=True).over(upto))
    run = Window.partitionBy(key, "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.coalesce("base", F.lit(0.0)) + F.sum(F.when(F.col("by_hand"), 0.0).otherwise(F.col("dur"))).over(run))
    start = F.when(F.col("by_hand"), F.col("a")).otherwise(F.round(F.col("upto") - F.col("dur"), 2))
    end = F.when(F.col("by_hand"), F.col("b")).otherwise(F.round("upto", 2))
    text = F.when(F.col("by_hand"), F.trim(F.regexp_extract("line", hand, 3))).otherwise(F.col("line"))
    return rows.select(key, "pos", start.alias("start"), end.alias("end"), text.alias("text"))


_OFFSETS = "struct<transcription:array<struct<offsets:struct<from:double,to:double>,text:string>>,segments:array<struct<start:double,end:double,text:string>>>"


def parse_asr_json(files: DataFrame, content: str = "content") -> DataFrame:
    """Recogniser output in either dialect: offsets in milliseconds, or segments in seconds; blank texts are left out."""
    others = [c for c in files.columns if c != content]
    doc = F.from_json(F.col(content), _OFFSETS)
    by_ms = F.transform(
        doc.transcription,
        lambda o: F.struct(F.round(o.offsets["from"] / 1000.0, 3).alias("start"), F.round(o.offsets["to"] / 1000.0, 3).alias("end"), F.trim(o.text).alias("text")),
    )
    by_s = F.transform(doc.segments, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.trim(s.text).alias("text")))
    segments = F.filter(F.coalesce(by_ms, by_s), lambda s: F.coalesce(s.text, F.lit("")) != "")
    return files.select(*others, F.posexplode(segments).alias("pos", "s")).select(*others, "pos", "s.*")
