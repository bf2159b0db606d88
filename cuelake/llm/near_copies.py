"""Near copies of whole texts by SimHash and an exact set-similarity join.

Two texts are linked when the sets of their word shingles (``WIDTH`` words, A-Z in lower case; a shorter text is one shingle)
have a Jaccard similarity of at least ``NUM / DEN``. SimHash finds links first; the join completes them, so no pair is lost.

0. Texts with equal sets meet in one aggregation, so copies never become pairs.
1. Fingerprints (of three-word shingles, as op6 makes them) within ``BITS`` bits are searched as in ``simhash`` (partitions, probes, components). Each set of a component meets the
   component's least one, so rows grow with sets, and the links that the sets confirm stand. Fingerprints miss many pairs of that similarity; the steps
   below find all pairs, but verify only those that SimHash hasn't joined.
2. The shingles of a set are ordered, common ones last, else by hash, and its prefix is the first p = n - ceil(t n) + 1 of n, t the least
   similarity. Prefixes travel as hashes, packed by bucket. Which are common comes from counts inside blocks over all texts, at most ``COMMON_MOST`` of
   them; any order finds the same pairs, but with this one passages that many texts share, and copies with many edits, make hardly any candidates.
3. Two sets of x and y shingles that are similar share s >= t (x + y) / (1 + t). Each lacks at most x - s or y - s of the other's, so
   their prefixes share at least the lesser of p_x - (x - s) and p_y - (y - s), which is one or more. Per bucket, the shared
   shingles of sets whose sizes and places fit are counted; pairs whose sum reaches that number are candidates.
4. A shingle that more than ``HOT_SETS`` different sets have in front makes no pairs: its sets, by size, are cut into blocks, and blocks whose sizes fit meet
   in cells of at most ``CELL_SETS`` a side. There shared shingles of prefixes are counted by a matrix product, and a pair is
   verified unless the cell already knows that links join the two. A cell returns a spanning forest, so rows grow
   with the sets of a group and not with its pairs. (A pair that shares such a shingle is found there, whatever it counts elsewhere.)
   A text goes to the cells of each such shingle in front of it, so smaller groups are cheaper by pairs.
5. Candidates are verified on the whole sets, made again from the texts. Links go to connected components.

A shingle and a set are known by 64 bits of hash; nothing is dropped.

Defined results: null and wordless texts have the empty set, and are copies of one another; rows that share a doc_id are rows of their own, those
whose texts are equal too leave one; null doc_ids count last; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks, simhash
from .common import cut, spare
from .graph import components

WIDTH = 5
#: Differing bits within which fingerprints are searched.
BITS = 3
#: The least similarity, NUM / DEN.
NUM, DEN = 4, 5
BUCKET_BYTES = 8 << 20
#: Sets with one shingle in front up to which pairs are made, and sets of a block of those with more.
HOT_SETS, CELL_SETS = 128, 512
#: Sets of one block that have a shingle, summed over blocks where two have it, from which it is common; and how many are kept as such.
COMMON, COMMON_MOST = 8, 1 << 20
LAST_ID = (1 << 63) - 1
_SIZE_BITS = 24
_U64 = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(offsets: np.ndarray, data: np.ndarray, width: int = WIDTH, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the different shingles of each text of a block, in order; bounds of the texts). common: sorted hashes that come last."""
    low = _LOWER[data]
    start, end, bound = blocks.find_words(offsets, low)
    n = np.diff(bound)
    many = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    first = blocks.ragged(bound[:-1], many)
    doc = np.repeat(np.arange(len(n)), many)
    last = np.minimum(first + width, bound[1:][doc])
    prefix = blocks.prefixes(blocks.word_hashes(low, start, end))
    found = blocks.mix64(blocks.slide(prefix, first, last) + (last - first).astype(_U64))
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    fresh = np.ones(len(found), dtype=bool)
    fresh[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    found, doc = found[fresh], doc[fresh]
    if common is not None and len(common) and len(found):
        late = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
        order = np.lexsort((found, late, doc))
        found, doc = found[order], doc[order]
    return found, np.searchsorted(doc, np.arange(len(n) + 1))


def common_shingles(texts: DataFrame, width: int, least: int = COMMON, most: int = COMMON_MOST) -> np.ndarray:
    """Sorted hashes of shingles that many different sets have, the commonest if there are very many; texts: text."""

    @blocks.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, offsets, data in blocks.text_blocks(batch.column(0)):
                found, bound = shingle_sets(offsets, data, width)
                some = np.unique(set_ids(found, bound), return_index=True)[1]
                h, n = np.unique(found[blocks.ragged(bound[some], np.diff(bound)[some])], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["h", "n"])

    sums = texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return np.sort(np.array([r["h"] for r in sums.orderBy(F.desc("n"), "h").limit(most).collect()], dtype=np.int64).view(_U64))


def set_ids(found: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """A hash of each set, whatever the order; 0 for the empty one."""
    total = np.zeros(len(found) + 1, dtype=_U64)
    np.cumsum(blocks.mix64(found ^ _U64(0xA0761D6478BD642F)), out=total[1:])
    return blocks.mix64(total[bound[1:]] - total[bound[:-1]] + np.diff(bound).astype(_U64)) * (np.diff(bound) > 0)


def prefix_size(n: np.ndarray) -> np.ndarray:
    """How many first shingles of a set of n travel."""
    return n - -(-NUM * n // DEN) + 1


def least_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many shingles sets of x and y share at least if they are similar."""
    return -(-NUM * (x + y) // (NUM + DEN))


def least_in_prefixes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of those are in both prefixes at least."""
    s = least_shared(x, y)
    return np.minimum(prefix_size(x) - (x - s), prefix_size(y) - (y - s))


def _packed(offsets: np.ndarray, data: np.ndarray, width: int, n_buckets: int, common: np.ndarray | None) -> Iterator[tuple[int, bytes]]:
    found, bound = shingle_sets(offsets, data, width, common)
    ids, size = set_ids(found, bound), np.diff(bound)
    some = np.unique(ids, return_index=True)[1]
    some = some[size[some] > 0]
    many = prefix_size(size[some])
    at = blocks.ragged(bound[some], many)
    place = blocks.ragged(np.zeros(len(some), dtype=np.int64), many)
    owner = np.repeat(some, many)
    key = blocks.mix64(found[at])
    bucket = (key % _U64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, top, owner, place = bucket[order], key[order] >> _U64(_SIZE_BITS), owner[order], place[order]
    which, first = np.unique(bucket, return_index=True)
    for b, x, y in zip(which.tolist(), first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True):
        parts = (top[x:y].astype("<u4"), (top[x:y] >> _U64(32)).astype(np.uint8), ids[owner[x:y]].astype("<u8"), size[owner[x:y]].astype("<u4"), place[x:y].astype("<u4"))
        yield b, b"".join(p.tobytes() for p in parts)


def _unpack(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, sets, sizes, places), each once, by key and size."""
    cols: list[list[np.ndarray]] = [[], [], [], []]
    for p in payloads:
        n = len(p) // 21
        cols[0].append(np.frombuffer(p, "<u4", n).astype(_U64) | np.frombuffer(p, np.uint8, n, 4 * n).astype(_U64) << _U64(32))
        cols[1].append(np.frombuffer(p, "<u8", n, 5 * n))
        cols[2].append(np.frombuffer(p, "<u4", n, 13 * n))
        cols[3].append(np.frombuffer(p, "<u4", n, 17 * n))
    key, ids, size, place = (np.concatenate(c) for c in cols)
    order = np.lexsort((place, ids, size, key))
    key, ids, size, place = key[order], ids[order], size[order].astype(np.int64), place[order].astype(np.int64)
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
    return key[fresh], ids[fresh], size[fresh], place[fresh]


def _counted(a: np.ndarray, b: np.ndarray, need: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(a, b, need, sum of n): each pair once."""
    order = np.lexsort((b, a))
    a, b, need, n = a[order], b[order], need[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, dtype=np.int64)
    return a[first], b[first], need[first], np.add.reduceat(n, first) if len(a) else n


def _cells(key: np.ndarray, ids: np.ndarray, size: np.ndarray, cell: int) -> tuple[np.ndarray, ...]:
    """(sets, keys, cells as numbers of two blocks, the set's block) of the sets of hot keys, given by key and size."""
    first = np.unique(key, return_index=True)[1].tolist()
    out = [tuple(np.zeros(0, dtype=t) for t in (_U64, _U64, np.int64, np.int64, np.int64))]
    for a, b in zip(first, [*first[1:], len(key)], strict=False):
        edges = list(range(a, b, cell)) + [b]
        for x in range(len(edges) - 1):
            for y in range(x + 1):
                # sizes ascend: the largest of block y against the least of block x
                if size[edges[y + 1] - 1] * DEN < NUM * size[edges[x]]:
                    continue
                for block in {x, y}:
                    some = slice(edges[block], edges[block + 1])
                    n = edges[block + 1] - edges[block]
                    out.append((ids[some], key[some], np.full(n, x), np.full(n, y), np.full(n, block)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _candidates(payloads: list[bytes], hot: int = HOT_SETS, cell: int = CELL_SETS, at_once: int = 2_000_000) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """((set hashes, smaller first; shingles that both prefixes must share; those they share here), cells of hot shingles)."""
    key, ids, size, place = _unpack(payloads)
    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
    common = count[which] > hot if len(key) else np.zeros(0, dtype=bool)
    cells = _cells(key[common], ids[common], size[common], cell)
    key, ids, size, place = key[~common], ids[~common], size[~common], place[~common]
    most = (1 << _SIZE_BITS) - 1
    front = key << _U64(_SIZE_BITS)
    ranked = front | np.minimum(size, most).astype(_U64)
    left = np.searchsorted(ranked, front | np.minimum(-(-NUM * size // DEN), most).astype(_U64), "left")
    # pairs with the earlier ones of the same key: sizes ascend
    many = np.maximum(np.arange(len(key)) - left, 0)
    found, at = [(np.zeros(0, dtype=_U64), np.zeros(0, dtype=_U64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))], 0
    upto = np.cumsum(many)
    while at < len(key):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + at_once, "right")))
        i = blocks.ragged(left[at:to], many[at:to])
        p = np.repeat(np.arange(at, min(to, len(key))), many[at:to])
        x, y = size[p], size[i]
        s = least_shared(x, y)
        ok = (s <= y) & (np.abs(place[i] - place[p]) + np.abs((y - place[i]) - (x - place[p])) <= x + y - 2 * s)
        i, p = i[ok], p[ok]
        need = least_in_prefixes(size[p], size[i])
        found.append(_counted(np.minimum(ids[i], ids[p]), np.maximum(ids[i], ids[p]), need, np.ones(len(i), dtype=np.int64)))
        at = to
    return _counted(*(np.concatenate(c) for c in zip(*found, strict=True))), cells


MET = "a long, b long, need long, n long, key long, x int, y int, block int"


def candidates(texts: DataFrame, width: int, hot: int = HOT_SETS, cell: int = CELL_SETS, common: np.ndarray | None = None) -> tuple[DataFrame, DataFrame]:
    """((a, b) set hashes, (set, key, x, y, block) of cells); texts: text."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(8, int(total // BUCKET_BYTES))

    @blocks.tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, offsets, data in blocks.text_blocks(batch.column(0)):
                got = list(_packed(offsets, data, width, n_buckets, common))
                b, p = zip(*got, strict=True) if got else ([], [])
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(p, pa.binary())], names=["bucket", "payload"])

    @blocks.tidy
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.int32()] * 3
        names = ["a", "b", "need", "n", "key", "x", "y", "block"]

        def out(held: list[bytes]) -> Iterator[pa.RecordBatch]:
            (a, b, need, n), (ids, key, x, y, block) = _candidates(held, hot, cell)
            cols = [pa.array(c, t) for c, t in zip((a.view(np.int64), b.view(np.int64), need, n), kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.nulls(len(a), t) for t in kinds[4:])], names=names)
            cols = [pa.array(c, t) for c, t in zip((key.view(np.int64), x, y, block), kinds[4:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), *(pa.nulls(len(ids), t) for t in kinds[1:4]), *cols], names=names)

        bucket, held = None, []
        for batch in batches:
            for b, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != bucket and held:
                    yield from out(held)
                    held = []
                bucket = b
                held.append(p)
        if held:
            yield from out(held)

    packed = texts.mapInArrow(send, "bucket int, payload binary")
    met = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, MET)
    # one aggregation for both kinds of rows, so that nothing is made twice and only what is left of the pairs is kept
    found = met.groupBy("a", "b", "key", "x", "y", "block").agg(F.max("need").alias("need"), F.sum("n").alias("n"))
    found = cut(found.filter("b is null or n >= need").drop("need", "n"))
    return found.filter("b is not null").select("a", "b"), found.filter("b is null").select(F.col("a").alias("set"), "key", "x", "y", "block")


def _sets(column: pa.Array, width: int, common: np.ndarray | None = None) -> Iterator[np.ndarray]:
    for _, _, offsets, data in blocks.text_blocks(column):
        found, bound = shingle_sets(offsets, data, width, common)
        for x, y in zip(bound[:-1], bound[1:], strict=True):
            yield found[x:y]


def verified(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs whose sets are similar. texts: set, text."""

    @blocks.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.slices(batches):
            ok = []
            for x, y in zip(_sets(batch.column(2), width), _sets(batch.column(3), width), strict=True):
                ok.append(similar(x, y))
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    named = pairs.join(texts.select(F.col("set").alias("a"), F.col("text").alias("x")), "a").join(
        texts.select(F.col("set").alias("b"), F.col("text").alias("y")), "b"
    )
    return named.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * DEN >= NUM * (len(x) + len(y) - both)


def cell_forest(left: dict[int, np.ndarray], right: dict[int, np.ndarray] | None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between two blocks of sets, or inside one."""
    ids, sets = (list(left), list(left.values())), (list(right), list(right.values())) if right is not None else None
    other = sets or ids
    front = [[x[: prefix_size(len(x))] for x in side[1]] for side in (ids, other)]
    common = np.intersect1d(*(np.unique(np.concatenate(f)) for f in front))
    shared = np.zeros((len(front[0]), len(front[1])), dtype=np.float32)
    for at in range(0, len(common), 4096):
        part = common[at : at + 4096]
        marks = []
        for f in front:
            m = np.zeros((len(f), len(part)), dtype=np.float32)
            for k, x in enumerate(f):
                m[k, np.searchsorted(part, np.intersect1d(x, part, assume_unique=True))] = 1
            marks.append(m)
        shared += marks[0] @ marks[1].T
    n, m = (np.array([len(x) for x in side[1]]) for side in (ids, other))
    x, y = np.maximum(n[:, None], m[None, :]), np.minimum(n[:, None], m[None, :])
    ok = (least_shared(x, y) <= y) & (shared >= least_in_prefixes(x, y))
    if right is None:
        ok &= np.arange(len(n))[:, None] < np.arange(len(m))[None, :]
    above: dict[int, int] = {}
    forest = []

    def root(h: int) -> int:
        while above.setdefault(h, h) != h:
            above[h] = h = above[above[h]]
        return h

    for i, j in zip(*(k.tolist() for k in np.nonzero(ok)), strict=True):
        a, b = root(ids[0][i]), root(other[0][j])
        if a != b and similar(ids[1][i], other[1][j]):
            above[a] = b
            forest.append((ids[0][i], other[0][j]))
    return forest


def linked_in_cells(cells: DataFrame, texts: DataFrame, width: int, common: np.ndarray | None = None) -> DataFrame:
    """(a, b): edges of the cells' spanning forests. texts: set, text."""

    @blocks.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(x: int, y: int, held: dict[int, dict[int, np.ndarray]]) -> pa.RecordBatch:
            pairs = cell_forest(held.get(x, {}), held.get(y, {}) if x != y else None) if held.get(x) and held.get(y) else []
            a, b = zip(*pairs, strict=True) if pairs else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        at, held = None, {}
        for batch in blocks.slices(batches):
            keys = zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)
            for (key, x, y, block, one), shingles in zip(keys, _sets(batch.column(5), width, common), strict=True):
                if (key, x, y) != at and at is not None:
                    yield out(at[1], at[2], held)
                    held = {}
                at = (key, x, y)
                held.setdefault(block, {})[one] = shingles
        if at is not None:
            yield out(at[1], at[2], held)

    named = cells.join(texts, "set").select("key", "x", "y", "block", "set", "text")
    return named.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(run, "a long, b long")


def _with_sets(docs: DataFrame, width: int) -> DataFrame:
    """(_d, _t, set, fp) of docs (_d, _t, text); fp: the fingerprint, by the operator's own width."""

    @blocks.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offsets, data in blocks.text_blocks(batch.column(2)):
                ids = set_ids(*shingle_sets(offsets, data, width)).view(np.int64)
                fps = np.array([simhash.fingerprint(t.as_py()) for t in batch.column(2).slice(a, b - a)], dtype=np.uint64).view(np.int64)
                kept = [batch.column(k).slice(a, b - a) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(ids), pa.array(fps)], names=["_d", "_t", "set", "fp"])

    return docs.mapInArrow(run, T.StructType([T.StructField(c, T.LongType()) for c in ("_d", "_t", "set", "fp")]))


def sketched(sets: DataFrame, max_bits: int = BITS) -> DataFrame:
    """(set, fp) -> (a, b): the least set of each component of near fingerprints with each other set of it."""
    named = cut(sets.join(simhash.classes(sets, max_bits), "fp").select("set", "label"))
    least = named.groupBy("label").agg(F.min("set").alias("a"))
    return named.join(least, "label").filter("set > a").select("a", F.col("set").alias("b"))


def not_joined(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs whose ends have no common head. links (a, b): b's head is a, and heads have none."""
    heads = [links.select(F.col("b").alias(f"_{end}"), F.col("a").alias(f"_{end}_head")) for end in ("a", "b")]
    found = pairs.join(heads[0], F.col("a") == F.col("_a"), "left").join(heads[1], F.col("b") == F.col("_b"), "left")
    return found.filter(F.coalesce("_a_head", "a") != F.coalesce("_b_head", "b")).select("a", "b")


def keep_first(docs: DataFrame, width: int = WIDTH, hot: int = HOT_SETS, cell: int = CELL_SETS) -> DataFrame:
    """docs with one row of each component: the smallest doc_id's, and of rows that share it one by a hash of the text."""
    d, t = spare(docs.columns, "d", "t")
    keyed = docs.withColumns({d: F.coalesce("doc_id", F.lit(LAST_ID)).cast("long"), t: F.coalesce(F.xxhash64("text"), F.lit(0))})
    rows = keyed.select(F.col(d).alias("_d"), F.col(t).alias("_t"), "text")
    first = cut(_with_sets(rows, width).groupBy("set").agg(F.min(F.struct("_d", "_t", "fp")).alias("first")))
    near = cut(sketched(first.select("set", "first.fp")))
    common = common_shingles(docs.select("text"), width)
    pairs, cells = candidates(docs.select("text"), width, hot, cell, common)
    both = pairs.union(near)
    ends = both.select(F.col("a").alias("set")).union(both.select("b")).union(cells.select("set")).distinct()
    named = ends.join(first, "set").select("set", F.col("first._d").alias("_kd"), F.col("first._t").alias("_kt"))
    texts = cut(rows.join(named, (F.col("_d") == F.col("_kd")) & (F.col("_t") == F.col("_kt"))).groupBy("set").agg(F.min("text").alias("text")))
    confirmed = cut(verified(near, texts, width))
    rest = verified(not_joined(pairs, confirmed), texts, width)
    label = components(cut(confirmed.unionByName(rest).unionByName(linked_in_cells(cells, texts, width, common))))
    stay = first.join(label, F.col("set") == F.col("node"), "left").groupBy(F.coalesce("label", "set").alias("label")).agg(F.min("first").alias("first"))
    kd, kt = spare(keyed.columns, "kd", "kt")
    stay = stay.select(F.col("first._d").alias(kd), F.col("first._t").alias(kt))
    kept = keyed.join(stay, (F.col(d) == F.col(kd)) & (F.col(t) == F.col(kt)), "left_semi")
    return kept.dropDuplicates([d, t]).select(*docs.columns)
