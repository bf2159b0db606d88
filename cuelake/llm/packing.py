"""Best-fit packing of token sequences by minimum bin slack.

Only the lengths matter to the packing, so the whole corpus comes down to a
histogram of at most ``capacity`` rows, however large it is. On it the
driver fills bin after bin: the longest piece left opens the bin, and a
bitset subset-sum over all lengths still available finds the fullest
combination for the rest, which is removed. A combination is taken as often in a row as
the counts allow, so the number of steps is bounded by the number of lengths too.
The result is a table of slots (length, first rank, ...), bounded likewise, which every
task uses to turn a piece's rank among those of its length into a place.

Ranks come from two windows: a piece's number within (length, salt), and the sum of the
salts before it. The number of salts follows the number of pieces, so a
length that a third of all pieces share is dealt over many tasks.

Defined results: null or empty text is the end mark alone; rows that share a
doc_id are packed each for itself; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks
from .common import cut, table

CAPACITY = 4096
EOS = 1
#: Pieces of one (length, salt), about.
SALT_ROWS = 20_000


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, eos: int = EOS, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): texts as ids with an end mark, cut at capacity."""

    @blocks.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import block_ids, encoder

        enc = encoder(path)
        for batch in batches:
            doc_id = batch.column(0)
            for a, b, offsets, data in blocks.text_blocks(batch.column(1)):
                ids, bound = block_ids(enc, offsets, data, eos)
                n = np.diff(bound)
                per = -(-n // capacity)
                row = np.repeat(np.arange(b - a), per)
                piece = blocks.ragged(np.zeros(b - a, dtype=np.int64), per)
                start = piece * capacity
                length = np.minimum(n[row] - start, capacity)
                first = bound[:-1][row] + start
                raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
                ends = (first + length) * 4
                crc = [zlib.crc32(raw[x:y]) for x, y in zip((first * 4).tolist(), ends.tolist(), strict=True)]
                cols = [doc_id.take(pa.array(row + a)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    at = pa.array(np.append(first, len(ids)), pa.int32())
                    cols.append(pa.ListArray.from_arrays(at, pa.array(ids.astype(np.int32))))
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names[: len(cols)])
        enc.forget()  # the worker lives on

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def fullest(avail: dict[int, int], gap: int) -> dict[int, int]:
    """The combination of available lengths with the greatest sum of at most gap, longer ones first."""
    mask, goal = (1 << (gap + 1)) - 1, 1 << gap
    bits, taken = 1, []
    for length in sorted((x for x in avail if x <= gap), reverse=True):
        left, many = min(avail[length], gap // length), 1
        while left:
            many = min(many, left)
            taken.append((length, many, bits))
            bits |= (bits << (length * many)) & mask
            if bits & goal:
                break
            left, many = left - many, many * 2
        if bits & goal:
            break
    at, found = bits.bit_length() - 1, {}
    for length, many, before in reversed(taken):
        if not before >> at & 1:
            at -= length * many
            found[length] = found.get(length, 0) + many
    return found


def minimum_bin_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """[(number of bins alike, {length: pieces in each})] that hold all pieces of the histogram."""
    avail = {k: n for k, n in histogram.items() if n}
    bins = []
    while avail:
        top = max(avail)
        avail[top] -= 1
        found = fullest({k: n for k, n in avail.items() if n}, capacity - top)
        avail[top] += 1
        found[top] = found.get(top, 0) + 1
        times = min(avail[k] // m for k, m in found.items())
        bins.append((times, found))
        for k, m in found.items():
            avail[k] -= times * m
            if not avail[k]:
                del avail[k]
    return bins


def slots(bins: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """Columns sorted by (length, first rank): which ranks of a length go where."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, found in bins:
        offset = 0
        for length in sorted(found, reverse=True):
            many = found[length]
            rows.append((length, used.get(length, 0), many, sequence, offset))
            used[length] = used.get(length, 0) + many * times
            offset += length * many
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "many", "sequence", "offset"), table.T, strict=True))


def ranked(pieces: DataFrame, n: int) -> DataFrame:
    """pieces with rank, from 0, among those of their length; pieces are checkpointed, so row numbers stay."""
    salts = max(1, n // SALT_ROWS) * 8
    rows = pieces.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)))
    per = rows.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")
    per = per.select("length", "_salt", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    rows = rows.withColumn("_own", own).join(per, ["length", "_salt"])
    return rows.withColumn("rank", F.col("_own") + F.col("_before")).drop("_own", "_before", "_salt")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, eos: int = EOS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset."""
    pieces = cut(cut_pieces(docs, path, capacity, eos, with_ids))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    at = slots(minimum_bin_slack(histogram, capacity))
    key = at["length"] * (1 << 44) + at["rank"]

    @blocks.tidy
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            k = np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1
            t = rank - at["rank"][k]
            kept = [c for c in batch.schema.names if c != "rank"]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            sequence = at["sequence"][k] + t // at["many"][k]
            offset = at["offset"][k] + t % at["many"][k] * length
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    cols = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    placed = ranked(pieces, sum(histogram.values())).select(*cols, F.col("rank").cast("long"))
    return placed.mapInArrow(place, schema + ", sequence_id long, offset long")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
