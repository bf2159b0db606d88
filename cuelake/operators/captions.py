"""Captions put together: cues of a subtitle file, the words said in them and who says them, within what a page shows.

Cues meet words by their number and speakers by shared time; a running sum says how many words still fit. All of it is joins and windows by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import checks, validation
from cuelake.functions.timecode import srt_time
from cuelake.sources import timedtext

from . import intervals

#: Cues and words of a page, characters of a cue and of a word, cues of a preview and characters of its lines.
CUES_MOST, WORDS_MOST, TEXT_MOST, WORD_MOST, PREVIEW_MOST, LINE_MOST = 1600, 20_000, 600, 120, 60, 300


def _numbered(cues: DataFrame, most: int) -> DataFrame:
    """The first cues of each document (doc, idx, start, end, text), with n (from 1), total, and the tag taken off the text."""
    w = Window.partitionBy("doc")
    total = cues.groupBy(F.col("doc").alias("_d")).agg(F.count("*").alias("total"))
    rows = cues.withColumn("n", F.row_number().over(w.orderBy("idx"))).filter(F.col("n") <= most).join(total, F.col("doc").eqNullSafe(F.col("_d")))
    tag = checks.cue_tag(F.col("text"))
    at = lambda c: F.round(checks.finite(F.col(c)), 3)
    return rows.select("doc", "n", "total", at("start").alias("start"), at("end").alias("end"), tag["speaker"].alias("tagged"), tag["text"].alias("text"))


def assembled(cues: DataFrame, words: DataFrame, lines: DataFrame, cues_most: int = CUES_MOST, words_most: int = WORDS_MOST) -> DataFrame:
    """doc, n, start, end, text, speaker, words, total, truncated (whether anything of the document up to this cue was left out).

    cues: doc, idx, start, end, text; words: doc, i (number of the cue, from 1), words (array of w, s, e); lines: doc, line, speaker, rs, re. A tag in the text
    outweighs the line that shares most time with the cue.
    """
    rows = _numbered(cues, cues_most)
    number = lambda x: F.round(checks.finite(x), 3)
    said = F.transform(F.filter("words", lambda w: F.coalesce(w["w"], F.lit("")) != ""), lambda w: F.struct(F.substring(w["w"], 1, WORD_MOST).alias("w"), number(w["s"]).alias("s"), number(w["e"]).alias("e")))
    given = words.select(F.col("doc").alias("_d"), F.col("i").alias("_i"), said.alias("said"))
    rows = rows.join(given, (F.col("doc") == F.col("_d")) & (F.col("n") == F.col("_i")), "left").drop("_d", "_i")
    size = F.coalesce(F.size("said"), F.lit(0))
    ahead = F.coalesce(F.sum(size).over(Window.partitionBy("doc").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.greatest(F.lit(0), F.least(size, F.lit(words_most) - ahead)).cast("int")
    rows = rows.withColumns({"room": room, "cut": (ahead >= words_most) | (ahead + size > words_most)})
    none = F.array().cast("array<struct<w:string,s:double,e:double>>")
    taken = F.when(F.col("room") > 0, F.slice("said", F.lit(1), F.greatest(F.col("room"), F.lit(1)))).otherwise(none)
    who = intervals.best_overlap(rows.select("doc", "n", F.col("start").alias("s"), F.col("end").alias("e")), lines.select("doc", "line", "rs", "re"), "doc", "n", "line")
    who = who.join(lines.select("doc", "line", "speaker"), ["doc", "line"]).select(F.col("doc").alias("_d"), F.col("n").alias("_n"), "speaker")
    rows = rows.withColumns({"taken": taken, "truncated": (F.col("total") > cues_most) | F.max("cut").over(Window.partitionBy("doc").orderBy("n"))})
    out = rows.join(who, (F.col("doc") == F.col("_d")) & (F.col("n") == F.col("_n")), "left")
    return out.select("doc", "n", "start", "end", F.substring("text", 1, TEXT_MOST).alias("text"), F.coalesce("tagged", "speaker").alias("speaker"), F.col("taken").alias("words"), "total", "truncated")


def summed(captions: DataFrame) -> DataFrame:
    """doc, count, total, words, karaoke, speakers, truncated of what ``assembled`` gives."""
    n = F.sum(F.size("words"))
    return captions.groupBy("doc").agg(
        F.count("*").alias("count"), F.max("total").alias("total"), n.alias("words"), (n > 0).alias("karaoke"), F.bool_or(F.col("speaker").isNotNull()).alias("speakers"), F.bool_or("truncated").alias("truncated")
    )


def previews(cues: DataFrame, most: int = PREVIEW_MOST) -> DataFrame:
    """doc, n, total, line: the lines of a shared page. A tag with a number other than 0 stays in front of the text."""
    rows = _numbered(cues, most)
    name = F.when(F.col("tagged") > 0, F.concat(F.lit("[S"), F.col("tagged").cast("string"), F.lit("] "))).otherwise("")
    line = F.substring(F.concat(name, F.trim(F.regexp_replace("text", r"\s+", " "))), 1, LINE_MOST)
    return rows.select("doc", "n", "total", F.concat(srt_time(F.col("start")), F.lit(" --> "), srt_time(F.col("end")), F.lit("  "), line).alias("line"))


def requested(body: Column, strict: bool = True) -> Column:
    """struct(code, at, cues) of a subtitle text sent to be analysed: why it is refused (and at which cue, by its number), or its cues, texts cut where that is allowed."""
    cues = timedtext.srt_cues(body)
    whole = F.struct(body.alias("body"), cues.alias("cues"))

    def judged(x: Column) -> Column:
        first = lambda bad: F.get(F.filter(x["cues"], bad), F.lit(0))["idx"]
        inside = lambda t, low: (t >= low) & (t <= validation.TIME_MOST)
        timing = first(lambda c: ~(inside(c["start"], F.lit(-validation.TIME_SLACK)) & inside(c["end"], c["start"] - validation.TIME_SLACK)))
        long = first(lambda c: F.length(c["text"]) > validation.CUE_MOST) if strict else F.lit(None).cast("int")
        code = (
            F.when(F.coalesce(x["body"], F.lit("")).rlike(r"\A\s*\z"), "no_srt").when(F.length(x["body"]) > validation.TEXT_MOST, "srt_too_long")
            .when(F.size(x["cues"]) > validation.LINES_MOST, "too_many_cues").when(timing.isNotNull(), "bad_timing").when(long.isNotNull(), "text_too_long")
        )
        at = F.when(code == "bad_timing", timing).when(code == "text_too_long", long)
        fine = F.transform(x["cues"], lambda c: F.struct(c["idx"].alias("idx"), c["start"].alias("start"), c["end"].alias("end"), F.substring(c["text"], 1, validation.CUE_MOST).alias("text")))
        return F.struct(code.alias("code"), at.alias("at"), F.when(code.isNull(), fine).alias("cues"))

    # the cues are parsed once, however often they are looked at
    return F.get(F.transform(F.array(whole), judged), F.lit(0))
