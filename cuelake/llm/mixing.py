"""Mixing sources to target weights (native).

Words are summed per source, a target is set for each source by water filling,
and its repetition rate is target / size. Each document is emitted
floor(rate) times, plus one more copy when a hash of its id, its text and its number among
equal rows, read as a number in [0, 1), is below the fraction of the rate.

Plan: one scan counts words, a partial aggregation per source shuffles one row per source and task, and the table of
rates joins back. That table is ranked by a range partitioning and levelled by aggregations, so it may have as many rows as it
likes; it is broadcast only while it has at most ``BROADCAST_ROWS`` rows, beyond that the join is left to adaptive execution, which splits hot
sources. Rows that are equal in id, text and source are told apart by a number, so that each has a draw of its own: keys that
occur once (nearly all) are set aside by an aggregation of 8-byte keys, and the others are numbered in salted groups.

Defined results: null text has size 0; null source is a source of its own and sorts last;
a source of size 0 has target 0 and no copies; a null doc_id or text draws as the text "null"; of equal rows it is not
defined which gets which draw, as nothing tells them apart; an empty table gives no rows.
``emit`` returns the columns it was given, whatever their names; ``mix`` replaces columns that carry one of its added names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, n_words, spare, table

BROADCAST_ROWS = 20_000
ADDED = ("size", "source_size", "target", "rate", "copies")
#: Rows of one key and salt, about, when equal rows are numbered.
SALT_ROWS = 20_000


def ranked(sizes: DataFrame) -> DataFrame:
    """(source, source_size, r): r is the place, from 1, by code point with null last, found without a single sorted partition."""
    ordered = sizes.select("source", "source_size").repartitionByRange(F.col("source").asc_nulls_last())
    ordered = ordered.sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("m", F.monotonically_increasing_id())
    ordered = cut(ordered.select("source", "source_size", F.shiftright("m", 33).alias("part"), F.col("m").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return ordered.join(F.broadcast(parts), "part").select("source", "source_size", (F.col("before") + F.col("at") + 1).alias("r"))


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> (source, source_size, target), by water filling.

    Sources by code point, null last, take the weights in turn. The level is what is left for a unit of weight once sources
    below it have stopped at their caps; it rises until no further source stops, each time by one aggregation of the sources.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("r") - 1) % len(weights) + 1).cast("int"))
    rows = ranked(sizes).withColumns({"w": w, "cap": F.col("source_size") * F.lit(cap)}).withColumn("ratio", F.col("cap") / F.col("w"))
    rows = cut(rows)
    total, stopped, level = rows.agg(F.sum("source_size")).first()[0] or 0, 0, 0.0
    while True:
        full = F.col("ratio") < F.lit(level)
        n, held, free = rows.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w")))).first()
        if n < stopped or not free:
            level = float("inf") if not free else level
            break
        at = (total * share - (held or 0.0)) / free
        if at <= level or n == stopped and level:
            level = max(level, at)
            break
        stopped, level = n, at
    return rows.select("source", "source_size", F.least(F.col("cap"), F.col("w") * F.lit(level)).alias("target"))


def draw(doc_id: Column, text: Column, number: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of a digest of id, text and number."""
    parts = [F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(F.md5(text), F.lit("null")), number.cast("string"), F.lit(seed)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number, from 0, among rows equal in doc_id, text and source."""
    key, twin, salt, before = spare([*docs.columns, name], "key", "twin", "salt", "before")
    rows = docs.withColumn(key, F.xxhash64("doc_id", "text", "source", F.isnull("text"), F.isnull("source")))
    twins = cut(rows.groupBy(key).count().filter("count > 1").withColumnsRenamed({key: twin, "count": "n"}))
    n, most = twins.agg(F.count("*"), F.max("n")).first()
    if not n:
        return docs.withColumn(name, F.lit(0).cast("long"))
    known = F.broadcast(twins.select(twin)) if n <= BROADCAST_ROWS else twins.select(twin)
    alone = rows.join(known, F.col(key) == F.col(twin), "left_anti").select(*docs.columns, F.lit(0).cast("long").alias(name))
    salts = max(1, most // SALT_ROWS)
    many = rows.join(known, F.col(key) == F.col(twin), "left_semi").withColumn(salt, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)))
    own = F.row_number().over(Window.partitionBy(key, salt).orderBy(F.lit(0))) - 1
    many = cut(many.withColumn(name, own))  # the numbers and the salts' sizes come from one drawing
    per = many.groupBy(F.col(key).alias(twin), F.col(salt).alias("s")).agg(F.count("*").alias("n"))
    per = per.select(twin, "s", (F.sum("n").over(Window.partitionBy(twin).orderBy("s")) - F.col("n")).alias(before))
    joined = many.join(per, (F.col(key) == F.col(twin)) & (F.col(salt) == F.col("s")))
    return alone.unionByName(joined.select(*docs.columns, (F.col(name) + F.col(before)).alias(name)))


def _mixed(docs: DataFrame, names: dict[str, str], weights, share: float, cap: float, seed: str, size: Column | None) -> DataFrame:
    size = n_words(F.col("text")) if size is None else size
    number, source = spare([*docs.columns, *names.values()], "number", "source")
    sizes = cut(docs.groupBy("source").agg(F.sum(size).alias("source_size")))
    targets = source_targets(sizes, weights, share, cap)
    targets = targets.select(F.col("source").alias(source), F.col("source_size").alias(names["source_size"]), F.col("target").alias(names["target"]))
    if sizes.count() <= BROADCAST_ROWS:
        targets = F.broadcast(targets)
    known, target, rate = F.col(names["source_size"]), F.col(names["target"]), F.col(names["rate"])
    rows = numbered(docs, number).withColumn(names["size"], size).join(targets, F.col("source").eqNullSafe(F.col(source))).drop(source)
    rows = rows.withColumn(names["rate"], F.when(known > 0, target / known).otherwise(F.lit(0.0)))
    extra = (draw(F.col("doc_id"), F.col("text"), F.col(number), seed) < rate - F.floor(rate)).cast("long")
    return rows.withColumn(names["copies"], F.floor(rate) + extra).drop(number)


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix", size: Column | None = None) -> DataFrame:
    """docs with size, source_size, target, rate and copies (how often the mix takes the row)."""
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ADDED])
    return _mixed(docs, {c: c for c in ADDED}, weights, share, cap, seed, size)


def emit(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix", size: Column | None = None) -> DataFrame:
    """Each row of docs as often as the mix takes it."""
    *names, copy = spare(docs.columns, *ADDED, "copy")
    names = dict(zip(ADDED, names, strict=True))
    mixed = _mixed(docs, names, weights, share, cap, seed, size).filter(F.col(names["copies"]) > 0)
    return mixed.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(names["copies"]).cast("int")))).select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, row_number() OVER (PARTITION BY doc_id, text, source) - 1 AS number, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS r FROM s
), w AS (
  SELECT *, CAST(CASE (r - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w, source_size * 2.0::DOUBLE AS cap FROM r
), f AS (
  SELECT *, cap / w AS ratio FROM w
), l AS (
  SELECT *, row_number() OVER (ORDER BY ratio, r) AS i,
    ((SELECT sum(source_size) FROM f) * 1.5::DOUBLE - (sum(cap) OVER (ORDER BY ratio, r ROWS UNBOUNDED PRECEDING) - cap))
    / ((SELECT sum(w) FROM f) - (sum(w) OVER (ORDER BY ratio, r ROWS UNBOUNDED PRECEDING) - w)) AS level
  FROM f
), v AS (
  SELECT arg_min(level, i) FILTER (WHERE level <= ratio) AS level FROM l
), t AS (
  SELECT source, source_size, least(cap, coalesce(w * (SELECT level FROM v), cap)) AS target FROM f
), x AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
    CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(d.text), 'null') || ':' || CAST(d.number AS VARCHAR) || ':mix'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM x
"""
