"""Where a recording's text comes from: the file itself, a text file beside it, or a stand-in; and outside providers as functions over rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text files, the stand-in's lines, names of one recogniser's program.
TEXT_SUFFIXES = (".txt", ".srt", ".vtt", ".md")
STAND_IN = (
    (0.0, 4.0, "[демо] Assalomu alaykum, bugun bizning mahsulot haqida gapiramiz."),
    (4.0, 8.0, "[демо] Buyurtma berish uchun Telegram botimizga yozing."),
)
CPP_NAMES = ("whisper-cli", "whisper.cpp", "whisper-cpp", "main")


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def chosen(media: DataFrame, texts: DataFrame) -> DataFrame:
    """path, source, content: 'own' for text files, 'sidecar' where a .txt file has the same stem, else 'stand_in' without content.

    media: path, content (null for sound); texts: path, content. One join on the stem.
    """
    beside = texts.filter(suffix(F.col("path")) == ".txt").select(stem(F.col("path")).alias("_stem"), F.col("content").alias("_beside"))
    rows = media.withColumn("_own", suffix(F.col("path")).isin(*TEXT_SUFFIXES)).join(beside, stem(F.col("path")) == F.col("_stem"), "left")
    source = F.when(F.col("_own"), "own").when(F.col("_stem").isNotNull(), "sidecar").otherwise("stand_in")
    return rows.select("path", source.alias("source"), F.when(F.col("_own"), F.col("content")).otherwise(F.col("_beside")).alias("content"))


def invented(media: DataFrame, texts: DataFrame) -> DataFrame:
    """Paths of recordings whose words nobody spoke: no text themselves, none beside them."""
    beside = texts.filter(suffix(F.col("path")) == ".txt").select(stem(F.col("path")).alias("_stem"))
    sound = media.filter(~suffix(F.col("path")).isin(*TEXT_SUFFIXES))
    return sound.join(beside, stem(F.col("path")) == F.col("_stem"), "left_anti").select("path")


def stand_in(paths: DataFrame) -> DataFrame:
    """The stand-in's segments for each path: path, pos, start, end, text."""
    lines = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("text")) for a, b, t in STAND_IN])
    return paths.select("path", F.posexplode(lines).alias("pos", "s")).select("path", "pos", "s.*")


def dialect(asked: Column, program: Column, model: Column) -> Column:
    """What a recogniser's answer looks like: as asked, else by the program's name or a .bin model."""
    name = F.lower(F.regexp_extract(F.coalesce(program, F.lit("")), r"([^/\\]*)$", 1))
    cpp = name.isin(*CPP_NAMES) | F.lower(F.coalesce(model, F.lit(""))).endswith(".bin")
    return F.when(asked.isin("openai", "whispercpp"), asked).when(cpp, "whispercpp").otherwise("openai")


def recognised(files: DataFrame, provider: Callable[[str, str], list[tuple[float, float, str]]]) -> DataFrame:
    """path, pos, start, end, text by an outside recogniser, called once a file where the file's row lies. files: path, lang."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, k, *s) for p, lang in zip(pdf["path"], pdf["lang"], strict=True) for k, s in enumerate(provider(p, lang))]
            yield pd.DataFrame(rows, columns=["path", "pos", "start", "end", "text"])

    return files.select("path", "lang").mapInPandas(run, "path string, pos int, start double, end double, text string")


def translated(text: Column, provider: Callable[[list[str]], list[str]]) -> Column:
    """A text by an outside translator, called once a batch with the batch's different texts. Null stays null."""

    def run(texts: pd.Series) -> pd.Series:
        known = texts.dropna().unique().tolist()
        to = dict(zip(known, provider(known), strict=True)) if known else {}
        return pd.Series([to.get(t) if isinstance(t, str) else None for t in texts], dtype=object)

    return F.pandas_udf(run, "string")(text)
