"""Sharding by fixed virtual slots (native).

A record is hashed into one of ``SLOTS`` virtual slots, a number that never changes. Bytes are summed per slot, and a map from slots to shards,
stored by version, says where a slot lives. Version 1 deals the slots round; rebalancing edits the latest version: a shard keeps its
largest slots up to an even share (of what slots too large for one leave), and what is over goes, largest first, each to the shard that is then least loaded. Shards are
then equal but for about one of the smallest slots. ``grown`` edits a map for one more shard, which takes slots only into itself.

The law of the query is ``bytes``: sizes near equal. The hash is of the id, the text and a number among equal rows, so that neither an id
nor a text nor a row that makes up a third of the table fills a slot.

Plan: one scan to a narrow table of ids, sizes and digests; a partial aggregation into ``SLOTS`` rows; the map has ``SLOTS`` rows whatever the input,
so it is one row's work to edit and is broadcast. Places in a shard come from numbering rows within a slot, or within parts of a slot of about
``PART_ROWS`` rows, plus the rows of the slots before it: no task sorts a shard.

Defined results: null text has 16 bytes and the checksum of nothing; a null id is an id like others; equal rows are records of their own, and which of them
gets which place is not defined, as nothing tells them apart; equal texts are not kept together; one record larger than an even share stays whole, so its shard is
the largest; an empty table gives no rows. Only doc_id and text are read, other columns may have any name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, ensure_checkpoint_dir, table
from .mixing import numbered

SLOTS = 8192
SHARDS = 40
#: Bytes that a record counts for beside its text.
OVERHEAD = 16
#: Rows of one part of a slot, about, when places are numbered.
PART_ROWS = 20_000
MAP = "virtual_slot int, shard int, version int"


def fraction(digits: Column) -> Column:
    """A number in [0, 1) from 13 hexadecimal digits."""
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, mark (hexadecimal digits that order the records of a slot), computed once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + F.lit(OVERHEAD)).cast("long")
    slim = docs.select("doc_id", F.md5("text").alias("text"), F.lit(None).cast("string").alias("source"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    parts = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.col("text"), F.lit("null")), F.col("number").cast("string")]
    rows = numbered(cut(slim), "number").withColumn("mark", F.md5(F.concat_ws(":", *parts)))
    slot = F.floor(fraction(F.substring("mark", 1, 13)) * slots).cast("int")
    return cut(rows.select("doc_id", "size", "text_crc32", slot.alias("virtual_slot"), F.substring("mark", 14, 19).alias("mark")))


def slot_bytes(rows: DataFrame) -> DataFrame:
    """virtual_slot, bytes, n of the slots that have records."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def first_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 1: slots dealt round."""
    return spark.range(slots, numPartitions=1).select(F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"), F.lit(1).alias("version"))


def _loaded(plan: DataFrame, sizes: DataFrame) -> DataFrame:
    known = sizes.select(F.col("virtual_slot").alias("s"), "bytes")
    return plan.join(known, F.col("virtual_slot") == F.col("s"), "left").select("virtual_slot", "shard", "version", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def _level(rows: DataFrame, shards: int) -> DataFrame:
    """rest, takers: the load that shards are to share, and the number of shards that share it, without slots that are larger than such a share."""
    down = Window.orderBy(F.desc("bytes"), "virtual_slot")  # over the slots, whose number is fixed
    left = F.sum("bytes").over(Window.partitionBy()) - F.sum("bytes").over(down) + F.col("bytes")
    r = rows.select("bytes", left.alias("rest"), (shards + 1 - F.row_number().over(down)).alias("takers"))
    first = F.max_by(F.struct("rest", "takers"), "takers").alias("f")
    return r.filter("takers > 0 AND bytes * takers <= rest").agg(first).select(F.coalesce("f.rest", F.lit(0)).alias("rest"), F.coalesce("f.takers", F.lit(1)).alias("takers"))


def rebalanced(plan: DataFrame, sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of a map: shards keep their largest slots up to an even share, the rest goes to the least loaded one by one.

    The fold over the slots that move is one row's work, of at most as many steps as there are slots.
    """
    rows = _loaded(plan, sizes)
    sofar = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot"))
    rows = rows.withColumn("sofar", sofar).crossJoin(F.broadcast(_level(rows, shards)))
    rows = rows.withColumn("stays", (F.col("bytes") == 0) | (F.col("sofar") * F.col("takers") <= F.col("rest")))
    stay = F.col("stays")
    loads = rows.groupBy("shard").agg(F.sum(F.when(stay, F.col("bytes")).otherwise(0)).alias("load"))
    every = rows.sparkSession.range(shards, numPartitions=1).select(F.col("id").cast("int").alias("k"))
    loads = every.join(loads, F.col("k") == F.col("shard"), "left").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("load", F.lit(0)).alias("load"), F.col("k").alias("shard")))).alias("loads"))
    moving = rows.filter(~stay).agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot"))).alias("moving"))
    begin = F.struct(F.col("loads"), F.array().cast("array<int>").alias("to"))

    def place(state: Column, slot: Column) -> Column:
        least = F.element_at(state["loads"], 1)
        more = F.struct((least["load"] - slot["less"]).alias("load"), least["shard"].alias("shard"))
        rest = F.slice(state["loads"], 2, shards)
        return F.struct(F.sort_array(F.concat(rest, F.array(more))).alias("loads"), F.concat(state["to"], F.array(least["shard"])).alias("to"))

    placed = moving.crossJoin(loads).select(F.arrays_zip(F.col("moving.virtual_slot").alias("virtual_slot"), F.aggregate("moving", begin, place)["to"].alias("shard")).alias("z")).select(F.inline("z"))
    placed = placed.toDF("virtual_slot", "shard")
    version = plan.agg((F.max("version") + 1).alias("version"))
    return rows.filter(stay).select("virtual_slot", "shard").unionByName(placed).crossJoin(F.broadcast(version)).select(*[c.split()[0] for c in MAP.split(", ")])


def grown(plan: DataFrame, sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version with one more shard, numbered ``shards``: each shard gives it its smallest slots, up to 1 / (shards + 1) of its load."""
    by_size = Window.partitionBy("shard").orderBy("bytes", "virtual_slot")
    rows = _loaded(plan, sizes).withColumns({"sofar": F.sum("bytes").over(by_size), "load": F.sum("bytes").over(Window.partitionBy("shard"))})
    goes = F.col("sofar") * (shards + 1) <= F.col("load")
    return rows.select("virtual_slot", F.when(goes, shards).otherwise(F.col("shard")).cast("int").alias("shard"), (F.col("version") + 1).alias("version"))


def store(plan: DataFrame, folder: str) -> None:
    """Adds a version to a stored map; the versions before it stay as they are."""
    plan.coalesce(1).write.mode("append").partitionBy("version").parquet(folder)


def stored(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version of a stored map, the latest if none is given."""
    plans = spark.read.schema(MAP).parquet(folder)
    wanted = plans.agg(F.max("version")).first()[0] if version is None else version
    return plans.filter(F.col("version") == F.lit(wanted))


def located(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with shard and slot, the place in the shard from 0 without gaps."""
    n, kinds = rows.agg(F.count("*"), F.approx_count_distinct("virtual_slot")).first()
    parts = max(1, n // max(1, kinds) // PART_ROWS)
    part = F.floor(fraction(F.substring("mark", 1, 13)) * parts).cast("int")
    rows = rows.join(F.broadcast(plan.select(F.col("virtual_slot").alias("s"), "shard")), F.col("virtual_slot") == F.col("s")).drop("s").withColumn("part", part)
    own = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("mark")) - 1
    per = rows.groupBy("shard", F.col("virtual_slot").alias("s"), F.col("part").alias("p")).agg(F.count("*").alias("n"))
    per = per.select("s", "p", (F.sum("n").over(Window.partitionBy("shard").orderBy("s", "p")) - F.col("n")).alias("before"))
    per = F.broadcast(per) if parts == 1 else per
    return rows.withColumn("own", own).join(per, (F.col("virtual_slot") == F.col("s")) & (F.col("part") == F.col("p"))).withColumn("slot", (F.col("own") + F.col("before")).cast("long")).drop("s", "p", "own", "before", "part")


def sharded(docs: DataFrame, folder: str, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, slot: docs by the map stored in ``folder``, made and rebalanced where there is none yet."""
    spark = docs.sparkSession
    rows = records(docs)
    sizes = slot_bytes(rows)
    store(first_map(spark, shards), folder)
    store(rebalanced(stored(spark, folder), sizes, shards), folder)
    return located(rows, stored(spark, folder))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/slots-{uuid.uuid4().hex}"
    rows = sharded(table(spark, sf_dir, "documents", "doc_id", "text"), folder)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


#: Remainders of the 16 four-bit numbers by the checksum's polynomial.
_CRC = [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]


def sql_crc32(text: str) -> str:
    """DuckDB SQL for the checksum of a text's bytes, four bits at a time."""
    halves = f"flatten(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: [strpos('0123456789ABCDEF', h[2]) - 1, strpos('0123456789ABCDEF', h[1]) - 1]))"
    return f"xor(4294967295, list_reduce({halves}, lambda c, b: xor(c >> 4, ({_CRC}::BIGINT[])[(xor(c, b) & 15) + 1]), 4294967295::BIGINT))"


OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, md5(text) AS digest, CAST(octet_length(encode(coalesce(text, ''))) + {OVERHEAD} AS BIGINT) AS size, {sql_crc32("coalesce(text, '')")} AS text_crc32 FROM documents
), m AS (
  SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(digest, 'null') || ':' || CAST(row_number() OVER (PARTITION BY doc_id, digest) - 1 AS VARCHAR)) AS mark FROM d
), r AS (
  SELECT doc_id, size, text_crc32, CAST(floor(CAST('0x' || substr(mark, 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE * {SLOTS}) AS INTEGER) AS v, substr(mark, 14) AS mark FROM m
), b AS (
  SELECT CAST(i AS INTEGER) AS v, CAST(i % {SHARDS} AS INTEGER) AS shard, CAST(coalesce(bytes, 0) AS BIGINT) AS bytes
  FROM range({SLOTS}) AS k(i) LEFT JOIN (SELECT v, sum(size) AS bytes FROM r GROUP BY v) AS s ON s.v = i
), l AS (
  SELECT arg_max({{'rest': rest, 'takers': takers}}, takers) AS l FROM (
    SELECT bytes, sum(bytes) OVER () - sum(bytes) OVER (ORDER BY bytes DESC, v) + bytes AS rest, {SHARDS} + 1 - row_number() OVER (ORDER BY bytes DESC, v) AS takers FROM b)
  WHERE takers > 0 AND bytes * takers <= rest
), k AS (
  SELECT b.*, bytes = 0 OR sum(bytes) OVER (PARTITION BY shard ORDER BY bytes DESC, v) * coalesce(l.takers, 1) <= coalesce(l.rest, 0) AS stays FROM b, l
), p AS (
  SELECT row_number() OVER (ORDER BY bytes DESC, v) AS i, v, bytes FROM k WHERE NOT stays
), f(i, v, shard, loads) AS (
  SELECT 0::BIGINT, NULL::INTEGER, NULL::INTEGER, list_sort(list({{'load': load, 'shard': shard}})) FROM (SELECT shard, CAST(sum(CASE WHEN stays THEN bytes ELSE 0 END) AS BIGINT) AS load FROM k GROUP BY shard)
  UNION ALL
  SELECT p.i, p.v, f.loads[1].shard, list_sort(list_append(f.loads[2:], {{'load': f.loads[1].load + p.bytes, 'shard': f.loads[1].shard}})) FROM f JOIN p ON p.i = f.i + 1
), t AS (
  SELECT v, shard FROM k WHERE stays UNION ALL SELECT v, shard FROM f WHERE i > 0
)
SELECT r.doc_id, r.size, r.text_crc32, 'bytes' AS law, t.shard, CAST(row_number() OVER (PARTITION BY t.shard ORDER BY r.v, r.mark) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, r.v AS virtual_slot
FROM r JOIN t ON r.v = t.v
"""
