"""Line dedup by a segment-partition edit join.

Lines that are equal, or within ``most`` edits of code points and at least ``MIN_CHARS`` long, are linked; a class is
what links connect, and its first line (smallest doc_id, then line number) stays. Shorter lines only go by equality.

1. Every distinct line of a block is cut into most + 1 segments of even length. It is indexed under (length, segment, content), and
   probes the substrings that can match a segment of a line of equal or smaller length: those whose start is within the
   shift that the edits left and right of the segment leave over. Segments and probes travel as hashes, packed by bucket.
2. Per bucket, probes look up the index. What leaves is a row for each line under a key that it shares with another, never
   a row for each pair: lines whose parities of characters differ in more than two bits an edit from all others of the key stay behind.
3. Only the lines named there are fetched, in a second scan that tests a Bloom filter of at most ``BLOOM_BITS`` bits (where more
   lines than that are named, more are fetched, and the joins drop them).
4. The lines of a key meet in cells of at most ``CELL_LINES`` a side, so a key that very many lines share is dealt over many tasks. A pair is
   verified by a banded bit-parallel edit distance, in the cell of the first segment that it shares and nowhere else. A cell returns
   how many links each line has there and a spanning forest of them: rows in proportion to its lines.
5. The forests go to connected components; classes meet the lines by hash, in joins that adaptive execution splits where a line is hot.

A line is known by 64 bits of hash. Blank lines are no lines: they are never linked and never removed, but a
text of which no line stays is empty. Null texts have no lines and stay null; null doc_ids count as the largest; rows that share
doc_id and text are one place, so both keep or lose the same lines; rows that share doc_id only go by a hash of their text; empty
tables give no rows. Extra columns pass through ``dedup_lines`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks
from .common import cut, spare, table
from .graph import components

MOST = 2
MIN_CHARS = 20
BLOOM_BITS = 1 << 26
BUCKET_BYTES = 8 << 20
#: Lines of either side that meet in one cell.
CELL_LINES = 512
#: Pairs of one key up to which parities are compared before lines are fetched; with more, all lines of the key are.
KEY_PAIRS = 1 << 16
#: Hashes of lines that a task remembers, so as to send each once.
SEEN_LINES = 1 << 20
LAST_ID = (1 << 63) - 1
_U64 = np.uint64
_K = (_U64(0xC2B2AE3D27D4EB4F), _U64(0x165667B19E3779F9))


def _before(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each place, and in all."""
    out = np.zeros(len(flags) + 1, dtype=np.int32)
    np.cumsum(flags, out=out[1:])
    return out


class Lines:
    """The lines of a block: bytes, place, hash, characters."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        n, n_docs = len(data), len(offsets) - 1
        newline = np.flatnonzero(data == 10)
        self.data = data
        self.start = np.sort(np.concatenate([offsets[:-1], newline + 1]))
        self.end = np.sort(np.concatenate([offsets[1:], newline]))
        upto = np.searchsorted(newline, offsets)
        self.per = np.diff(upto) + 1
        self.doc = np.repeat(np.arange(n_docs), self.per)
        self.line = blocks.ragged(np.zeros(n_docs, dtype=np.int64), self.per)
        seen = _before(~blocks.IS_SPACE[data])
        self.real = seen[self.end] > seen[self.start]
        self.prefix = blocks.prefixes(blocks.byte_codes()[data])
        self.hash = blocks.mix64(blocks.slide(self.prefix, self.start, self.end) + (self.end - self.start).astype(_U64))
        lead = (data & 0xC0) != 0x80
        self.chars_before = _before(lead)
        self.char_at = np.append(np.flatnonzero(lead).astype(np.int32), np.int32(n))
        self.lead = lead

    def parity(self, some: np.ndarray) -> np.ndarray:
        """For each line, bit k says whether characters of kind k (of 32) occur an odd number of times."""
        bits = np.where(self.lead, np.uint32(1) << (self.data & 31).astype(np.uint32), np.uint32(0))
        run = np.concatenate([np.zeros(1, np.uint32), np.bitwise_xor.accumulate(bits)]) if len(bits) else np.zeros(1, np.uint32)
        return run[self.end[some]] ^ run[self.start[some]]


def segment(length: np.ndarray, k: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of the k-th of ``parts`` even segments; the last ones take what is over."""
    base, over = length // parts, length % parts
    return k * base + np.maximum(0, k - (parts - over)), base + (k >= parts - over)


def probe_shifts(k: int, delta: int, most: int) -> range:
    """Where, around segment k of a line ``delta`` shorter, a substring can start: at most k edits lie before it and most - k after."""
    return range(max(-k, delta - (most - k)), min(k, delta + (most - k)) + 1)


def signatures(lines: Lines, some: np.ndarray, most: int, least: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """((keys, lines) of the index, (keys, lines) of the probes) for the chosen lines; the four highest bits of a key are its segment."""
    c0 = lines.chars_before[lines.start[some]].astype(np.int64)
    length = lines.chars_before[lines.end[some]] - c0

    def keys(rows: np.ndarray, k: int, of: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        first = lines.char_at[c0[rows] + at]
        last = lines.char_at[c0[rows] + at + size]
        found = blocks.mix64(blocks.slide(lines.prefix, first, last) + of.astype(_U64) * _K[0] + _U64(k + 1) * _K[1])
        return found >> _U64(4) | _U64(k) << _U64(60)

    index, probe = [], []
    everything = np.arange(len(some))
    for k in range(most + 1):
        at, size = segment(length, k, most + 1)
        index.append((keys(everything, k, length, at, size), some))
        for delta in range(most + 1):
            of = length - delta
            at, size = segment(of, k, most + 1)
            for shift in probe_shifts(k, delta, most):
                rows = np.flatnonzero((of >= least) & (at + shift >= 0) & (at + shift + size <= length))
                probe.append((keys(rows, k, of[rows], (at + shift)[rows], size[rows]), some[rows]))
    return tuple(tuple(np.concatenate(x) for x in zip(*part, strict=True)) for part in (index, probe))  # type: ignore[return-value]


def _fresh(lines: Lines, least: int, seen: np.ndarray) -> np.ndarray:
    """The first place of each long enough line of a block that is not among the sorted hashes ``seen``."""
    length = lines.chars_before[lines.end] - lines.chars_before[lines.start]
    some = np.flatnonzero(lines.real & (length >= least))
    some = some[np.unique(lines.hash[some], return_index=True)[1]]
    if len(seen):
        h = lines.hash[some]
        some = some[seen[np.minimum(np.searchsorted(seen, h), len(seen) - 1)] != h]
    return some


def _packed(lines: Lines, some: np.ndarray, most: int, least: int, n_buckets: int) -> Iterator[tuple[int, bytes]]:
    if not len(some):
        return
    parity = np.zeros(len(lines.hash), dtype=np.uint32)
    parity[some] = lines.parity(some)
    sides = []
    for key, line in signatures(lines, some, most, least):
        bucket = (key % _U64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sides.append((bucket[order], key[order], line[order]))
    edges = [np.searchsorted(b, np.arange(n_buckets + 1)) for b, _, _ in sides] if n_buckets < 1 << 16 else None
    for bucket in np.unique(np.concatenate([sides[0][0], sides[1][0]])).tolist():
        parts: list[np.ndarray] = []
        for k, (b, key, line) in enumerate(sides):
            x, y = (edges[k][bucket], edges[k][bucket + 1]) if edges else np.searchsorted(b, [bucket, bucket + 1])
            top = key[x:y] >> _U64(24)
            at = line[x:y]
            parts += [np.array([y - x], "<u4"), top.astype("<u4"), (top >> _U64(32)).astype(np.uint8), lines.hash[at].astype("<u8"), parity[at].astype("<u4")]
        yield bucket, b"".join(p.tobytes() for p in parts)


def _unpack(payloads: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """[(keys, line hashes, parities) of the index, of the probes], each once and sorted by key."""
    cols: list[list[list[np.ndarray]]] = [[[], [], []], [[], [], []]]
    for p in payloads:
        at = 0
        for side in cols:
            n = int(np.frombuffer(p, "<u4", 1, at)[0])
            at += 4
            low, high = np.frombuffer(p, "<u4", n, at), np.frombuffer(p, np.uint8, n, at + 4 * n)
            side[0].append(low.astype(np.uint64) | high.astype(np.uint64) << _U64(32))
            side[1].append(np.frombuffer(p, "<u8", n, at + 5 * n))
            side[2].append(np.frombuffer(p, "<u4", n, at + 13 * n))
            at += 17 * n
    out = []
    for side in cols:
        key, line, parity = (np.concatenate(c) for c in side)
        order = np.lexsort((line, key))
        key, line, parity = key[order], line[order], parity[order]
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
        out.append((key[fresh], line[fresh], parity[fresh]))
    return out


def _group(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each in its run of equal keys, number of the run, sizes of the runs) of sorted keys."""
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = keys[1:] != keys[:-1]
    run = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    return np.arange(len(keys)) - first[run], run, np.diff(np.append(first, len(keys)))


def _entries(payloads: list[bytes], most: int, cell: int = CELL_LINES, at_once: int = 2_000_000) -> tuple[np.ndarray, ...]:
    """(keys, side: 0 index or 1 probe, lines, block of the line on its side, blocks on the other side) of lines that share a key with another one."""
    (ik, il, ip), (pk, pl, pp) = _unpack(payloads)
    left, right = np.searchsorted(ik, pk, "left"), np.searchsorted(ik, pk, "right")
    _, run, size = _group(pk)
    many = right - left
    large = many * (size[run] if len(pk) else many) > KEY_PAIRS
    hit = (np.zeros(len(ik), dtype=bool), large & (many > 0))
    edge = np.zeros(len(ik) + 1, dtype=np.int64)
    np.add.at(edge, left[large], 1)
    np.add.at(edge, right[large], -1)
    hit[0][:] = np.cumsum(edge)[:-1] > 0
    many = np.where(large, 0, many)
    at, upto = 0, np.cumsum(many)
    while at < len(pk):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + at_once, "right")))
        i = blocks.ragged(left[at:to], many[at:to])
        p = np.repeat(np.arange(at, min(to, len(pk))), many[at:to])
        ok = (il[i] != pl[p]) & (np.bitwise_count(ip[i] ^ pp[p]) <= 2 * most)
        hit[0][i[ok]] = True
        hit[1][p[ok]] = True
        at = to
    keys, cols = (ik[hit[0]], pk[hit[1]]), []
    for side, (key, line) in enumerate(((ik, il), (pk, pl))):
        key, line, other = key[hit[side]], line[hit[side]], keys[1 - side]
        rank, _, _ = _group(key)
        across = np.searchsorted(other, key, "right") - np.searchsorted(other, key, "left")
        cols.append((key, np.full(len(key), side), line, rank // cell, -(-across // cell)))
    return tuple(np.concatenate(c) for c in zip(*cols, strict=True))


def within_edits(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` edits part two strings: bit vectors over a band of 2 * most + 1 diagonals."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return False
    same, end = 0, len(a)
    while same < end and a[same] == b[same]:
        same += 1
    longer = len(b) - len(a)
    while end > same and a[end - 1] == b[end - 1 + longer]:
        end -= 1
    a, b = a[same:end], b[same : end + longer]
    if not a:
        return len(b) <= most
    width = 2 * most + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    # bit j of the band in column i is row i + j - most of b; vertical steps in it are +1 (up) or -1 (down)
    # where: for each character its rows in the band, as bits, and the column that they were last moved to
    where: dict[str, tuple[int, int]] = {}
    for row, c in enumerate(b[:most]):
        where[c] = (where.get(c, (0, 0))[0] | 1 << (row + most), 0)
    up, down = mask ^ ((1 << most) - 1), 0
    score = most
    for i, c in enumerate(a):
        if i + most < len(b):
            bits, at = where.get(b[i + most], (0, i))
            where[b[i + most]] = (bits >> (i - at) | top, i)
        bits, at = where.get(c, (0, i))
        match = bits >> (i - at)
        diagonal = ((((match & up) + up) ^ up) | match | down) & mask
        right_up = (down | ~(diagonal | up)) & mask
        right_down = diagonal & up
        last = len(b) - 1 - i + most  # the band's bit of the last row
        if last >= width - 1:
            score += not diagonal & top
        else:
            score += (right_up >> last & 1) - (right_down >> last & 1)
        slid = diagonal >> 1
        up = (right_down | ~(slid | right_up)) & mask
        down = slid & right_up
    return score <= most


def first_shared(x: str, y: str, most: int) -> int:
    """The first segment of y that x has where at most ``most`` edits allow it; -1 if none. x is as long as y or longer."""
    delta = len(x) - len(y)
    for k in range(most + 1):
        base, over = divmod(len(y), most + 1)
        at, size = k * base + max(0, k - (most + 1 - over)), base + (k >= most + 1 - over)
        if any(at + shift >= 0 and x.startswith(y[at : at + size], at + shift) for shift in probe_shifts(k, delta, most)):
            return k
    return -1


def _parity(text: str) -> int:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return int(np.bitwise_xor.reduce(np.uint32(1) << (raw[(raw & 0xC0) != 0x80] & 31).astype(np.uint32), initial=np.uint32(0)))


def cell_links(k: int, index: dict[int, str], probe: dict[int, str], most: int) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """(links of each line, edges of a spanning forest of them) between the lines of a cell of segment k, by line hash.

    A pair belongs to the cell of the first segment that it shares, with the longer line (of like ones, the one of smaller hash) as the probe.
    """
    hi, hp = (np.fromiter(x, dtype=np.int64, count=len(x)) for x in (index, probe))
    ti, tp = list(index.values()), list(probe.values())
    li, lp = (np.array([len(t) for t in x]) for x in (ti, tp))
    bi, bp = (np.array([_parity(t) for t in x], dtype=np.uint32) for x in (ti, tp))
    delta = lp[:, None] - li[None, :]
    ok = (delta <= most) & ((delta > 0) | (delta == 0) & (hp[:, None] < hi[None, :])) & (np.bitwise_count(bp[:, None] ^ bi[None, :]) <= 2 * most)
    degree: dict[int, int] = {}
    above: dict[int, int] = {}
    forest = []

    def root(h: int) -> int:
        while above.setdefault(h, h) != h:
            above[h] = h = above[above[h]]
        return h

    for p, i in zip(*(x.tolist() for x in np.nonzero(ok)), strict=True):
        x, y = tp[p], ti[i]
        if first_shared(x, y, most) == k and within_edits(x, y, most):
            a, b = int(hp[p]), int(hi[i])
            degree[a] = degree.get(a, 0) + 1
            degree[b] = degree.get(b, 0) + 1
            if (ra := root(a)) != (rb := root(b)):
                above[ra] = rb
                forest.append((a, b))
    return degree, forest


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.filter("text is not null").select(
        F.coalesce("doc_id", F.lit(LAST_ID)).cast("long").alias("doc"), F.xxhash64("text").alias("tkey"), "text"
    )


ENTRIES = "key long, k int, side int, h long, block int, across int"


def candidates(rows: DataFrame, most: int, least: int, cell: int = CELL_LINES) -> DataFrame:
    """A row for each line under each key that it shares with another one; rows: doc, tkey, text."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(8, int(total // BUCKET_BYTES))

    @blocks.tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, dtype=_U64)
        for batch in batches:
            for _, _, offsets, data in blocks.text_blocks(batch.column(0)):
                lines = Lines(offsets, data)
                some = _fresh(lines, least, seen)
                seen = np.union1d(seen if len(seen) < SEEN_LINES else seen[:0], lines.hash[some])
                got = list(_packed(lines, some, most, least, n_buckets))
                b, p = zip(*got, strict=True) if got else ([], [])
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(p, pa.binary())], names=["bucket", "payload"])

    @blocks.tidy
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(bucket: int, held: list[bytes]) -> pa.RecordBatch:
            key, side, line, block, across = _entries(held, most, cell)
            whole = (key << _U64(24) | _U64(bucket & 0xFFFFFF)).view(np.int64)
            k = (key >> _U64(36)).astype(np.int32)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
            cols = (whole, k, side, line.view(np.int64), block, across)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["key", "k", "side", "h", "block", "across"])

        bucket, held = None, []
        for batch in batches:
            for b, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != bucket and held:
                    yield out(bucket, held)
                    held = []
                bucket = b
                held.append(p)
        if held:
            yield out(bucket, held)

    packed = rows.select("text").mapInArrow(send, "bucket int, payload binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, ENTRIES)


def bloom(hashes: DataFrame, n: int) -> np.ndarray:
    """A bit array of at most BLOOM_BITS bits with the bit of each hash (one long column h) set."""
    bits = min(BLOOM_BITS, max(1 << 10, 1 << (16 * max(n, 1) - 1).bit_length()))
    low = F.col("h").bitwiseAND(F.lit(bits - 1))
    word = F.shiftright(low, 6).alias("word")
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    out = np.zeros(bits // 64, dtype=np.int64)
    for r in hashes.select(word, bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[r["word"]] = r["bits"]
    return out.view(np.uint64)


def occurrences(rows: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(doc, tkey, line, h, text): every line; the text of those whose hash's bit is set in ``wanted``."""
    bits = _U64(len(wanted) * 64 - 1)

    @blocks.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offsets, data in blocks.text_blocks(batch.column(2)):
                lines = Lines(offsets, data)
                real = np.flatnonzero(lines.real)
                h, at = lines.hash[real], pa.array(lines.doc[real] + a)
                low = h & bits
                hit = (wanted[(low >> _U64(6)).astype(np.int64)] >> (low & _U64(63)) & _U64(1)).astype(bool)
                raw = data.tobytes()
                text = [raw[lines.start[k] : lines.end[k]].decode("utf-8", "replace") if x else None for k, x in zip(real, hit, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(lines.line[real], pa.int32()), pa.array(h.view(np.int64)), pa.array(text, pa.string())],
                    names=["doc", "tkey", "line", "h", "text"],
                )

    return rows.mapInArrow(run, "doc long, tkey long, line int, h long, text string")


def verified(entries: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """(a, b, n): with b, an edge of a cell's spanning forest; without, n links of line a found in a cell. texts: h, text."""

    @blocks.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(k: int, sides: tuple[dict[int, str], dict[int, str]]) -> pa.RecordBatch:
            degree, forest = cell_links(k, *sides, most)
            a, b, n = [*degree, *(x for x, _ in forest)], [None] * len(degree) + [y for _, y in forest], [*degree.values(), *[None] * len(forest)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, n)], names=["a", "b", "n"])

        cell, k, sides = None, 0, ({}, {})
        for batch in batches:
            for key, part, x, y, side, h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, part, x, y) != cell and cell is not None:
                    yield out(k, sides)
                    sides = ({}, {})
                cell, k = (key, part, x, y), part
                sides[side][h] = text
        if cell is not None:
            yield out(k, sides)

    spread = entries.join(texts, "h").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("across") - 1)))
    index = F.col("side") == 0
    cells = spread.select("key", "k", F.when(index, F.col("block")).otherwise(F.col("other")).alias("x"), F.when(index, F.col("other")).otherwise(F.col("block")).alias("y"), "side", "h", "text")
    at = ["key", "k", "x", "y"]
    return cells.repartition(*at).sortWithinPartitions(*at).mapInArrow(run, "a long, b long, n long")


def line_classes(docs: DataFrame, most: int = MOST, least: int = MIN_CHARS, cell: int = CELL_LINES) -> tuple[DataFrame, DataFrame]:
    """(every line: doc, tkey, line, h; every different line: h, first (doc, tkey, line) of its class, n_links)."""
    rows = _keyed(docs)
    entries = cut(candidates(rows, most, least, cell))
    named = entries.select("h").distinct()
    found = cut(occurrences(rows, bloom(named, named.count())))
    texts = found.filter("text is not null").groupBy("h").agg(F.min("text").alias("text"))
    links = cut(verified(entries, texts, most))
    degree = links.filter("b is null").groupBy(F.col("a").alias("h")).agg(F.sum("n").alias("n_links"))
    label = components(links.filter("b is not null").select("a", "b")).select(F.col("node").alias("h"), "label")
    # few rows against all lines; computed once, as the plan below has them twice
    linked = cut(label.join(degree, "h"))
    distinct = found.groupBy("h").agg(F.min(F.struct("doc", "tkey", "line")).alias("own"))
    distinct = distinct.join(linked, "h", "left")
    distinct = distinct.select("h", "own", F.coalesce("label", "h").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    first = distinct.groupBy("label").agg(F.min("own").alias("first"))
    return found.drop("text"), distinct.join(first, "label").select("h", "first", "n_links")


def dedup_lines(docs: DataFrame, most: int = MOST, least: int = MIN_CHARS) -> DataFrame:
    """docs with the first line of each class left in the texts; n_chars, if there, follows the text."""
    _, classes = line_classes(docs, most, least)
    d, t, kd, kt, stay_lines = spare(docs.columns, "d", "t", "kd", "kt", "kept")
    kept = classes.select("first").distinct().groupBy(F.col("first.doc").alias(kd), F.col("first.tkey").alias(kt)).agg(F.collect_list("first.line").alias(stay_lines))
    keyed = docs.withColumns({d: F.coalesce("doc_id", F.lit(LAST_ID)).cast("long"), t: F.xxhash64("text")})
    joined = keyed.join(kept, (F.col(d) == F.col(kd)) & (F.col(t) == F.col(kt)), "left")
    at = docs.columns.index("text")
    out = T.StructType(docs.schema.fields)

    @blocks.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.slices(batches):
            texts = []
            for text, kept in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if text:
                    stay = set(kept or ())
                    lines = [x for k, x in enumerate(text.split("\n")) if k in stay or not x.strip(" \t\n\x0b\x0c\r")]
                    text = "\n".join(lines) if stay else ""
                texts.append(text)
            cols = list(batch.columns[:-1])
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-1])

    done = joined.select(*[F.col(f"`{c}`") for c in docs.columns], stay_lines).mapInArrow(run, out)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line with words: doc_id, line, its class (doc_id and line of the first), links to different lines, kept."""
    lines, classes = line_classes(table(spark, sf_dir, "documents", "doc_id", "text"))
    joined = lines.join(classes, "h")
    kept = (F.col("first.doc") == F.col("doc")) & (F.col("first.tkey") == F.col("tkey")) & (F.col("first.line") == F.col("line"))
    name = lambda c: F.when(c != LAST_ID, c)
    return joined.select(
        name(F.col("doc")).alias("doc_id"), "line", name(F.col("first.doc")).alias("class_doc_id"), F.col("first.line").alias("class_line"), "n_links", kept.alias("kept")
    )
