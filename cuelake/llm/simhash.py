"""SimHash near-duplicates with general pigeonhole search.

A document's 64 bits are the majority of the XXH64 hashes of its word shingles. Equal
fingerprints meet in one aggregation, so copies never become pairs. Distinct ones within
``max_bits`` differing bits are found as follows.

* Bits that go together (by correlation over a bounded sample of distinct fingerprints) share a partition.
* With thresholds t_i (-1: partition unused) whose sum of t_i + 1 is max_bits + 1, any two
  fingerprints that differ in at most max_bits bits differ in at most t_i bits of some partition i.
  Dynamic programming sets the thresholds, unequal where that is cheaper: the cost is the number of probes plus the
  candidates expected from the sample's pairs, carried to the number of distinct fingerprints.
  Two to eight partitions are tried, so more data get wider partitions and more probes instead of more candidates.
* A fingerprint is indexed under its bits in each used partition and probes all values within t_i bits.
  The join verifies the whole distance, and keeps a pair only in the first partition that can find it.

Links then go to connected components. A bucket holds distinct fingerprints only,
so a group of near copies, however large, adds at most as many rows as it has different fingerprints.

Defined results: null or wordless text has fingerprint zero, and is linked like any other; rows that share a doc_id
each get a row; rows without an id count last for component_id, which is null where a component has no others; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, spare, table
from .graph import components

#: Distinct fingerprints sampled to group the bits and to estimate candidates.
SAMPLE = 2048
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64 majority bits of a text's shingle hashes, as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)))
    n = len(shingles)
    digest = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), dtype=">u8", count=n).view(np.uint8).reshape(n, 8)
    ones = np.concatenate([np.bincount(digest[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """docs with fp (the fingerprint as a signed long) in place of text."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width, seed) for t in batch.column(at)], dtype=np.uint64)
            cols, names = list(batch.columns), list(batch.schema.names)
            cols[at], names[at] = pa.array(found.view(np.int64)), "fp"
            yield pa.RecordBatch.from_arrays(cols, names=names)

    fields = [T.StructField("fp", T.LongType()) if f.name == "text" else f for f in docs.schema.fields]
    return docs.mapInArrow(run, T.StructType(fields))


def group_bits(sample: np.ndarray, m: int) -> list[int]:
    """m masks over the 64 bits, of widths as equal as can be; bits that go together share one."""
    bits = (sample[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(float)
    bits -= bits.mean(axis=0)
    norm = np.sqrt((bits**2).sum(axis=0)) + 1e-9
    together = np.abs(bits.T @ bits / np.outer(norm, norm))
    np.fill_diagonal(together, 0)
    left, masks = list(range(64)), []
    for k in range(m):
        width = 64 // m + (k < 64 % m)
        part = [left[int(together[np.ix_(left, left)].sum(axis=1).argmax())]]
        left.remove(part[0])
        while len(part) < width:
            part.append(left.pop(int(together[np.ix_(left, part)].sum(axis=1).argmax())))
        masks.append(sum(1 << b for b in part))
    return masks


def within(sample: np.ndarray, mask: int, most: int) -> list[float]:
    """Shares of pairs of fingerprints that differ in at most 0 .. most bits of mask: the sample's, or what independent bits give if more."""
    part = sample & np.uint64(mask)
    seen, pairs = np.zeros(most + 1), max(1, len(part) * (len(part) - 1) // 2)
    for k in range(0, len(part), 256):
        apart = np.bitwise_count(part[k : k + 256, None] ^ part[None, :])
        upper = np.arange(len(part))[None, :] > np.arange(k, min(k + 256, len(part)))[:, None]
        seen += [np.count_nonzero((apart <= e) & upper) for e in range(most + 1)]
    w = mask.bit_count()
    alone = [sum(comb(w, i) for i in range(e + 1)) / 2.0**w for e in range(most + 1)]
    return [max(s / pairs, a) for s, a in zip(seen, alone, strict=True)]


def allocate(sample: np.ndarray, n: int, max_bits: int) -> list[tuple[int, int]]:
    """[(mask, threshold)] of the used partitions, at the least expected cost for n distinct fingerprints."""
    best: tuple[float, list[tuple[int, int]]] = (float("inf"), [])
    for m in range(2, 9):
        masks = group_bits(sample, m)
        # state: sum of t + 1 so far -> (cost, thresholds)
        states: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for mask in masks:
            share = within(sample, mask, max_bits)
            after: dict[int, tuple[float, list[int]]] = {}
            for total, (cost, chosen) in states.items():
                for t in range(-1, max_bits - total + 1):
                    probes = sum(comb(mask.bit_count(), i) for i in range(t + 1))
                    more = cost + (n * (probes + 1) + n * n / 2 * share[t] if t >= 0 else 0)
                    if more < after.get(total + t + 1, (float("inf"),))[0]:
                        after[total + t + 1] = (more, [*chosen, t])
            states = after
        cost, chosen = states.get(max_bits + 1, (float("inf"), []))
        if cost < best[0]:
            best = cost, [(mask, t) for mask, t in zip(masks, chosen, strict=True) if t >= 0]
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _apart(mask: int) -> Column:
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(F.lit(_signed(mask))))


def links(fps: DataFrame, max_bits: int = 3, sample_rows: int = SAMPLE) -> DataFrame:
    """Distinct fp -> (a, b), all pairs within max_bits differing bits, each once, a and b different."""
    n = fps.count()
    if n < 2:
        return fps.sparkSession.createDataFrame([], "a long, b long")
    drawn = fps.orderBy(F.xxhash64("fp"), "fp").limit(sample_rows).collect()
    sample = np.array([r["fp"] for r in drawn], dtype=np.int64).view(np.uint64)
    used = allocate(sample, n, max_bits)
    flips = []
    for mask, t in used:
        bits = [1 << b for b in range(64) if mask >> b & 1]
        flips.append([_signed(sum(c)) for e in range(t + 1) for c in combinations(bits, e)])
    def keys(side: str, values: list[list[int]]) -> DataFrame:
        each = F.array(*[F.struct(F.lit(i).alias("p"), F.col("fp").bitwiseAND(F.lit(_signed(used[i][0]))).alias("k")) for i in range(len(used))])
        rows = fps.select(F.col("fp").alias(side), F.explode(each).alias("_k")).select(side, "_k.p", F.col("_k.k").alias("k"))
        if all(len(v) == 1 for v in values):
            return rows
        flip = F.element_at(F.array(*[F.array(*[F.lit(x) for x in v]) for v in values]), F.col("p") + 1)
        return rows.select(side, "p", F.explode(flip).alias("_f"), "k").select(side, "p", F.col("k").bitwiseXOR(F.col("_f")).alias("k"))

    index = keys("b", [[0]] * len(used))
    probe = keys("a", flips)
    earlier = F.lit(False)
    for i, (mask, t) in enumerate(used[:-1]):
        earlier |= (F.lit(i) < F.col("probe.p")) & (_apart(mask) <= t)
    found = probe.alias("probe").join(
        index.alias("index"),
        (F.col("probe.p") == F.col("index.p"))
        & (F.col("probe.k") == F.col("index.k"))
        & (F.col("a") < F.col("b"))
        & (_apart((1 << 64) - 1) <= max_bits)
        & ~earlier,
    )
    return found.select("a", "b")


def classes(rows: DataFrame, max_bits: int = 3) -> DataFrame:
    """rows with fp -> (fp, label): distinct fingerprints and the least one that links reach from each."""
    distinct = cut(rows.select("fp").distinct())
    found = components(links(distinct, max_bits))
    return distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42, max_bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    rows = cut(fingerprints(docs.select("doc_id", "text"), width, seed))
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    joined = cut(classes(rows, max_bits).join(first, "fp"))
    least = joined.groupBy("label").agg(F.min("first").alias("component_id"))
    named = joined.join(least, "label").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(named, F.col("fp") == F.col("_fp")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, width: int = 3, seed: int = 42, max_bits: int = 3) -> DataFrame:
    """docs with one row of each component: the smallest doc_id's, and of rows that share it one by a hash of the text.

    The ids that stay join the texts by id, so no component is gathered anywhere.
    """
    d, t, kd, kt = spare(docs.columns, "d", "t", "kd", "kt")
    keyed = docs.withColumns({d: F.coalesce("doc_id", F.lit((1 << 63) - 1)).cast("long"), t: F.coalesce(F.xxhash64("text"), F.lit(0))})
    rows = cut(fingerprints(keyed.select(F.col(d).alias("_d"), F.col(t).alias("_t"), "text"), width, seed))
    first = rows.groupBy("fp").agg(F.min(F.struct("_d", "_t")).alias("first"))
    stay = classes(rows, max_bits).join(first, "fp").groupBy("label").agg(F.min("first").alias("first"))
    stay = stay.select(F.col("first._d").alias(kd), F.col("first._t").alias(kt))
    kept = keyed.join(stay, (F.col(d) == F.col(kd)) & (F.col(t) == F.col(kt)), "left_semi")
    return kept.dropDuplicates([d, t]).select(*docs.columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
