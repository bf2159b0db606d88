"""Substring dedup by seed and extend.

A window is ``length`` consecutive words. Its seed is the winnowed anchor inside it, the first ``gram``-word gram of least hash, so
equal windows have equal seeds at equal places. Documents meet on seeds; from each seed that they share, matches are extended
to the left and to the right a word at a time, and what reaches ``length`` words is covered; covered windows
that follow one another are the maximal repeats.

1. Anchors. Each block of documents (a few MB) drops windows that an earlier window of the same block repeats (a combine before the
   shuffle: a passage that a third of all documents share leaves one copy per block). The anchors of the others travel alone, as hash,
   place and position, packed by hash bucket. An anchor found in one place only goes no further.
2. Extension. The documents of shared anchors send the words around them, as hashes, to the anchor's bucket. There all
   occurrences are extended by one word after another on either side; those that still agree stay in one class. An occurrence whose window
   has an earlier one in its class is covered. The work is linear in the occurrences: no pairs are formed.
3. Hot anchors. One with more than ``HOT`` occurrences (or of which a task alone finds many) doesn't meet in one bucket: the windows that hold it
   do, each in the bucket of its own hash, after each task has kept the earliest of equal ones. So a common phrase, or the edge of
   a passage that very many documents share, is dealt over all buckets.
4. Covered runs are gathered per document and joined to its text.

Anchors are told apart by 64 bits, the words around them by 32 bits each, windows of hot anchors by 64 bits. The number of buckets
follows the bytes of text, so a task's memory doesn't grow; nothing goes to the driver but that sum.

Defined results: null text has no words; a null doc_id counts as the largest; rows that share both doc_id and
text are one place, so neither makes the other's windows repeats, and both get the same result; rows that share
doc_id only go by a hash of their text; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .common import table

LENGTH = 20
GRAM = 5
#: Bytes of text for each bucket, about.
BUCKET_BYTES = 6 << 20
#: Occurrences of an anchor that meet in one bucket at most.
HOT = 4096
#: Occurrences, by a table of 2**COUNTER_BITS counters, from which a task calls an anchor hot itself.
TASK_HOT, COUNTER_BITS = 256, 20
#: Entries that a task holds before it sorts out what can leave.
HELD = 1 << 20
LAST_ID = (1 << 63) - 1
_U64 = np.uint64
#: What a row carries: anchors of a bucket, covered runs, shared anchors, hot anchors, names of hot anchors, windows.
ANCHORS, COVERED, SHARED, HOT_SHARED, HOT_NAMES, WINDOWS = range(6)
SCHEMA = "bucket int, doc long, tkey long, kind int, payload binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("doc", pa.int64()), ("tkey", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])


def _least(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(minimum, its first place) of each ``width`` consecutive values."""
    have, at = 1, np.arange(len(values))
    while have < width:
        step = min(have, width - have)
        right = values[step:] < values[:-step]
        values, at = np.where(right, values[step:], values[:-step]), np.where(right, at[step:], at[:-step])
        have += step
    return values, at


def _repeats(key: np.ndarray, doc: np.ndarray, tkey: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in the order of their places: which are the first with their key, and which repeat one at another place."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    fresh = np.ones(len(k), dtype=bool)
    fresh[1:] = k[1:] != k[:-1]
    source = order[np.maximum.accumulate(np.where(fresh, np.arange(len(k)), 0))]
    first = np.zeros(len(k), dtype=bool)
    first[order[fresh]] = True
    covered = np.zeros(len(k), dtype=bool)
    covered[order] = (doc[source] != doc[order]) | (tkey[source] != tkey[order]) | (start[source] != start[order])
    return first, covered


def _ranges(doc: np.ndarray, tkey: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(doc, tkey, runs of window starts as pairs of 32-bit numbers) of covered windows in the order of their places."""
    if not len(start):
        return
    same = (doc[1:] == doc[:-1]) & (tkey[1:] == tkey[:-1])
    cut = np.flatnonzero(~(same & (start[1:] == start[:-1] + 1))) + 1
    at, to = np.concatenate([[0], cut]), np.concatenate([cut, [len(start)]])
    pairs = np.stack([start[at], start[to - 1] + 1], axis=1).astype("<u4")
    own = np.flatnonzero(~same) + 1
    split = np.concatenate([[0], np.searchsorted(at, own), [len(at)]])
    for a, b in zip(split[:-1].tolist(), split[1:].tolist(), strict=True):
        yield int(doc[at[a]]), int(tkey[at[a]]), pairs[a:b].tobytes()


def _positions(doc: np.ndarray, tkey: np.ndarray, pos: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(doc, tkey, positions as 32-bit numbers) of each document."""
    order = np.lexsort((pos, tkey, doc))
    doc, tkey, pos = doc[order], tkey[order], pos[order].astype("<u4")
    cut = np.flatnonzero((doc[1:] != doc[:-1]) | (tkey[1:] != tkey[:-1])) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(doc)], strict=True):
        if b > a:
            yield int(doc[a]), int(tkey[a]), pos[a:b].tobytes()


def _spread(x: tuple[int, int], n_buckets: int) -> int:
    """A bucket for what only passes through."""
    return abs(x[0] * 31 + x[1]) % n_buckets


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)


def _bucketed(bucket: np.ndarray, cols: tuple[np.ndarray, ...]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns' parts by bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, cols = bucket[order], [c[order] for c in cols]
    cut = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(bucket)], strict=True):
        if b > a:
            yield int(bucket[a]), [c[a:b] for c in cols]


def _of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return (blocks.mix64(keys ^ _U64(0xA5A5A5A5)) % _U64(n_buckets)).astype(np.int64)


def _join(cols: list[list[np.ndarray]], kinds: tuple[str, ...]) -> list[np.ndarray]:
    return [np.concatenate([np.zeros(0, dtype=k), *c]) for c, k in zip(cols, kinds, strict=True)]


#: Columns of packed anchors and of packed windows: hash, doc, tkey, place in the document.
_PLACED = ("<u8", "<i8", "<i8", "<u4")


def _pack(cols: list[np.ndarray]) -> bytes:
    return b"".join(c.astype(k).tobytes() for c, k in zip(cols, _PLACED, strict=True))


def _unpack(payloads: list[bytes]) -> list[np.ndarray]:
    cols: list[list[np.ndarray]] = [[] for _ in _PLACED]
    for p in payloads:
        n, at = len(p) // 28, 0
        for col, kind in zip(cols, _PLACED, strict=True):
            col.append(np.frombuffer(p, kind, n, at))
            at += col[-1].nbytes
    return _join(cols, _PLACED)


class Windows:
    """The windows of a block in the order of their places: doc, tkey, start, anchor (hash and position); words' hashes."""

    def __init__(self, doc: np.ndarray, tkey: np.ndarray, offsets: np.ndarray, data: np.ndarray, length: int, gram: int):
        start, end, bound = blocks.find_words(offsets, data)
        per = np.maximum(np.diff(bound) - (length - 1), 0)
        self.n = int(per.sum())
        self.length = length
        if not self.n:
            return
        self.words = blocks.word_hashes(data, start, end)
        self.prefix = blocks.prefixes(self.words)
        at = np.arange(len(self.words) - gram + 1)
        least, where = _least(blocks.mix64(blocks.slide(self.prefix, at, at + gram)), length - gram + 1)
        order = np.lexsort((tkey, doc))
        self.place = blocks.ragged(bound[:-1][order], per[order])
        self.row = np.repeat(order, per[order])
        self.base = bound[:-1][self.row]
        self.doc, self.tkey, self.start = doc[self.row], tkey[self.row], self.place - self.base
        self.anchor, self.pos = least[self.place], where[self.place] - self.base

    def hashes(self, some: np.ndarray | slice = slice(None)) -> np.ndarray:
        at = self.place[some]
        return blocks.mix64(blocks.slide(self.prefix, at, at + self.length))


def _first_of_runs(row: np.ndarray, pos: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Where, in the order of places, the row or the anchor's position changes (or starts don't follow one another)."""
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (pos[1:] != pos[:-1])
    if start is not None:
        fresh[1:] |= start[1:] != start[:-1] + 1
    return np.flatnonzero(fresh)


def send_anchors(batches: Iterator[pa.RecordBatch], length: int, gram: int, n_buckets: int, task_hot: int) -> Iterator[pa.RecordBatch]:
    """Step 1, before the shuffle."""
    counters = np.zeros(1 << COUNTER_BITS, dtype=np.int64)
    named = np.zeros(0, dtype=_U64)
    for batch in batches:
        doc, tkey = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for a, b, offsets, data in blocks.text_blocks(batch.column(2)):
            w = Windows(doc[a:b], tkey[a:b], offsets, data, length, gram)
            if not w.n:
                continue
            first, covered = _repeats(w.hashes(), w.doc, w.tkey, w.start)
            rows = [(_spread(x, n_buckets), *x[:2], COVERED, x[2]) for x in _ranges(w.doc[covered], w.tkey[covered], w.start[covered])]
            some = np.flatnonzero(first)
            some = some[_first_of_runs(w.row[some], w.pos[some])]
            key = w.anchor[some]
            slot = (key & _U64(len(counters) - 1)).astype(np.int64)
            np.add.at(counters, slot, 1)
            hot = counters[slot] > task_hot
            names = np.setdiff1d(key[hot], named)
            named = np.union1d(named, names)
            rows += [(bucket, None, None, HOT_NAMES, k.tobytes()) for bucket, (k,) in _bucketed(_of(names, n_buckets), (names,))]
            rows += [(_spread(x, n_buckets), *x[:2], HOT_SHARED, x[2]) for x in _positions(w.doc[some[hot]], w.tkey[some[hot]], w.pos[some[hot]])]
            some, key = some[~hot], key[~hot]
            rows += [(bucket, None, None, ANCHORS, _pack(cols)) for bucket, cols in _bucketed(_of(key, n_buckets), (key, w.doc[some], w.tkey[some], w.pos[some]))]
            yield _batch(rows)


def _shared(held: list[np.ndarray], hot: np.ndarray, most: int, last: bool) -> tuple[list[np.ndarray], np.ndarray, list[tuple]]:
    """(entries that stay, hot anchors known, rows that can leave) of a bucket's anchors; at the last call none stay."""
    key, doc, tkey, pos = held
    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
    many = count[which] if len(key) else np.zeros(0, dtype=np.int64)
    hot = np.union1d(hot, key[many > most])
    is_hot = np.isin(key, hot)
    rows = [(*x[:2], HOT_SHARED, x[2]) for x in _positions(doc[is_hot], tkey[is_hot], pos[is_hot])]
    if last:
        ready = ~is_hot & (many > 1)
        rows += [(*x[:2], SHARED, x[2]) for x in _positions(doc[ready], tkey[ready], pos[ready])]
        return [c[:0] for c in held], hot, rows
    return [c[~is_hot] for c in held], hot, rows


def meet_anchors(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Step 1, by bucket: which anchors are in more places than one, which in more than ``most``."""
    none = _unpack([])
    bucket, held, payloads, size, hot, rows = None, none, [], 0, np.zeros(0, dtype=_U64), []

    def settle(last: bool) -> None:
        nonlocal held, hot, payloads, size
        held, hot, found = _shared([np.concatenate(c) for c in zip(held, _unpack(payloads), strict=True)], hot, most, last)
        rows.extend((bucket, *x) for x in found)
        payloads, size = [], 0

    for batch in batches:
        for b, doc, tkey, kind, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != bucket:
                if bucket is not None:
                    settle(True)
                bucket, hot = b, hot[:0]
            if kind == ANCHORS:
                payloads.append(payload)
                size += len(payload) // 28
                if size > HELD:
                    settle(False)
            elif kind == HOT_NAMES:
                hot = np.union1d(hot, np.frombuffer(payload, "<u8"))
            else:
                rows.append((b, doc, tkey, kind, payload))
        yield _batch(rows)
        rows.clear()
    if bucket is not None:
        settle(True)
        yield _batch(rows)


def _pick(w: Windows, of: dict[int, list[bytes]]) -> np.ndarray:
    """Which windows have their anchor at one of the positions given for their row."""
    row = np.concatenate([np.full(sum(map(len, x)) // 4, r) for r, x in of.items()] or [np.zeros(0, dtype=np.int64)])
    pos = np.concatenate([np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in of.values()] or [np.zeros(0, dtype=np.int64)])
    top = int(max(w.pos.max(initial=0), pos.max(initial=0))) + 1
    return np.isin(w.row * top + w.pos, row * top + pos)


def send_contexts(batches: Iterator[pa.RecordBatch], length: int, gram: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Step 2 and 3, before the shuffle: words around shared anchors; windows of hot ones. batches: doc, tkey, text, found (kind, payload) and more."""
    held: list[list[np.ndarray]] = [[], [], [], []]

    def settle() -> list[tuple]:
        key, doc, tkey, start = _join(held, _PLACED)
        for c in held:
            c.clear()
        order = np.lexsort((start, tkey, doc))
        key, doc, tkey, start = key[order], doc[order], tkey[order], start[order].astype(np.int64)
        first, covered = _repeats(key, doc, tkey, start)
        rows = [(_spread(x, n_buckets), *x[:2], COVERED, x[2]) for x in _ranges(doc[covered], tkey[covered], start[covered])]
        cols = tuple(c[first] for c in (key, doc, tkey, start))
        return rows + [(bucket, None, None, WINDOWS, _pack(part)) for bucket, part in _bucketed(_of(cols[0], n_buckets), cols)]

    for batch in batches:
        doc, tkey, found = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_pylist()
        for a, b, offsets, data in blocks.text_blocks(batch.column(2)):
            rows: list[tuple] = []
            of: tuple[dict, dict] = ({}, {})
            for k in range(a, b):
                for x in found[k]:
                    if x["kind"] == COVERED:
                        rows.append((_spread((doc[k].item(), tkey[k].item()), n_buckets), doc[k].item(), tkey[k].item(), COVERED, x["payload"]))
                    else:
                        of[x["kind"] == HOT_SHARED].setdefault(k - a, []).append(x["payload"])
            w = Windows(doc[a:b], tkey[a:b], offsets, data, length, gram)
            if w.n and of[1]:
                some = np.flatnonzero(_pick(w, of[1]))
                for col, x in zip(held, (w.hashes(some), w.doc[some], w.tkey[some], w.start[some].astype(np.uint32)), strict=True):
                    col.append(x)
                if sum(map(len, held[0])) > HELD:
                    rows += settle()
            if w.n and of[0]:
                some = np.flatnonzero(_pick(w, of[0]))
                at = _first_of_runs(w.row[some], w.pos[some], w.start[some])
                many = np.diff(np.append(at, len(some)))
                at = some[at]
                cols = (w.anchor[at], w.doc[at], w.tkey[at], w.start[at], many, w.pos[at] - w.start[at], w.place[at])
                for bucket, (m, d, t, s, n, off, first) in _bucketed(_of(cols[0], n_buckets), cols):
                    words = w.words[blocks.ragged(first, n + length - 1)]
                    kinds = ("<u4", "<u8", "<i8", "<i8", "<u4", "<u4", "<u4", "<u4")
                    parts = (np.array([len(m)]), m, d, t, s, n, off, words >> _U64(32))
                    rows.append((bucket, None, None, ANCHORS, b"".join(p.astype(k).tobytes() for p, k in zip(parts, kinds, strict=True))))
            yield _batch(rows)
    if held[0]:
        yield _batch(settle())


def _contexts(payloads: list[bytes], length: int) -> list[np.ndarray]:
    """Columns of packed occurrences: anchor, doc, tkey, start of the first window, windows, place of the anchor in it; words."""
    kinds = ("<u8", "<i8", "<i8", "<u4", "<u4", "<u4", "<u4")
    cols: list[list[np.ndarray]] = [[] for _ in kinds]
    for p in payloads:
        n, at = int(np.frombuffer(p, "<u4", 1)[0]), 4
        for col, kind in zip(cols[:-1], kinds[:-1], strict=True):
            col.append(np.frombuffer(p, kind, n, at))
            at += col[-1].nbytes
        cols[-1].append(np.frombuffer(p, "<u4", -1, at))
    return _join(cols, kinds)


def extend(payloads: list[bytes], length: int, gram: int) -> list[tuple[int, int, bytes]]:
    """Covered runs among the occurrences of a bucket's anchors.

    ``left[a]`` and ``right[b]`` are the classes of occurrences that agree on the anchor and the a words before, or the b words after
    it; each comes from the one before by one more word. A window with its anchor at place a is matched by those with which it shares
    ``left[a]`` and ``right[length - gram - a]``.
    """
    anchor, doc, tkey, start, many, off, words = _contexts(payloads, length)
    many, off, start = many.astype(np.int64), off.astype(np.int64), start.astype(np.int64)
    size = many + length - 1
    base = np.cumsum(size) - size
    reach = length - gram
    left = np.empty((reach + 1, len(anchor)), dtype=_U64)
    right = np.empty((reach + 1, len(anchor)), dtype=_U64)
    left[0], right[0] = anchor, anchor
    word = lambda at: words[np.clip(at, 0, max(len(words) - 1, 0))].astype(_U64)
    for step in range(1, reach + 1):
        # where the words of the occurrence end, classes are never asked for
        left[step] = blocks.mix64(left[step - 1] + _U64(0x9E3779B97F4A7C15) * (word(base + off - step) + _U64(1)))
        right[step] = blocks.mix64(right[step - 1] + _U64(0xC2B2AE3D27D4EB4F) * (word(base + off + gram - 1 + step) + _U64(1)))
    run = np.repeat(np.arange(len(anchor)), many)
    j = blocks.ragged(np.zeros(len(many), dtype=np.int64), many)
    a = off[run] - j
    key = blocks.mix64(left[a, run] ^ blocks.mix64(right[reach - a, run] + a.astype(_U64)))
    d, t, s = doc[run], tkey[run], start[run] + j
    order = np.lexsort((s, t, d))
    d, t, s = d[order], t[order], s[order]
    _, covered = _repeats(key[order], d, t, s)
    return list(_ranges(d[covered], t[covered], s[covered]))


def meet_contexts(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Steps 2 and 3, by bucket: covered runs."""

    def settle(payloads: dict[int, list[bytes]]) -> list[tuple[int, int, bytes]]:
        key, doc, tkey, start = _unpack(payloads[WINDOWS])
        order = np.lexsort((start, tkey, doc))
        doc, tkey, start = doc[order], tkey[order], start[order].astype(np.int64)
        _, covered = _repeats(key[order], doc, tkey, start)
        return [*_ranges(doc[covered], tkey[covered], start[covered]), *extend(payloads[ANCHORS], length, gram)]

    bucket, held, rows = None, {ANCHORS: [], WINDOWS: []}, []
    for batch in batches:
        for b, doc, tkey, kind, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != bucket and bucket is not None:
                rows += [(bucket, *x[:2], COVERED, x[2]) for x in settle(held)]
                held = {ANCHORS: [], WINDOWS: []}
            bucket = b
            if kind == COVERED:
                rows.append((b, doc, tkey, kind, payload))
            else:
                held[kind].append(payload)
        yield _batch(rows)
        rows = []
    if bucket is not None:
        yield _batch([(bucket, *x[:2], COVERED, x[2]) for x in settle(held)])


def covered_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, task_hot: int = TASK_HOT) -> DataFrame:
    """(doc, tkey, ranges): runs of starts of windows that occur earlier. docs: doc, tkey, doc_id, text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(8, int(total // BUCKET_BYTES))
    rows = docs.select("doc", "tkey", "doc_id", "text")  # all columns of the caller's join, so that both use one exchange of the texts
    by_bucket = lambda df: df.repartition("bucket").sortWithinPartitions("bucket")
    anchors = by_bucket(docs.select("doc", "tkey", "text").mapInArrow(lambda x: send_anchors(x, length, gram, n, task_hot), SCHEMA)).mapInArrow(lambda x: meet_anchors(x, hot), SCHEMA)
    found = anchors.groupBy("doc", "tkey").agg(F.collect_list(F.struct("kind", "payload")).alias("found"))
    shared = rows.join(found, ["doc", "tkey"]).select("doc", "tkey", "text", "found", "doc_id")
    covered = by_bucket(shared.mapInArrow(lambda x: send_contexts(x, length, gram, n), SCHEMA)).mapInArrow(lambda x: meet_contexts(x, length, gram), SCHEMA)
    return covered.groupBy("doc", "tkey").agg(F.collect_list("payload").alias("ranges"))


def kept_words(text: str | None, ranges: list[bytes] | None, length: int = LENGTH) -> tuple[list[bytes], int]:
    """(words that stay, number of words) of a text whose windows at the given starts repeat earlier ones."""
    words = (text or "").encode().split()
    if not ranges:
        return words, len(words)
    n = len(words)
    edge = np.zeros(n + 1, dtype=np.int64)
    pairs = np.frombuffer(b"".join(ranges), "<u4").reshape(-1, 2).astype(np.int64)
    np.add.at(edge, pairs[:, 0], 1)
    np.add.at(edge, pairs[:, 1] + length - 1, -1)
    stay = np.cumsum(edge[:n]) == 0
    return [words[k] for k in np.flatnonzero(stay).tolist()], n


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = True, hot: int = HOT, task_hot: int = TASK_HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked, kept_text: the words that stay, joined by a space."""
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).cast("long").alias("doc"), F.xxhash64("text").alias("tkey"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = covered_ranges(rows, length, gram, hot, task_hot)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.slices(batches):
            out = []
            for text, ranges in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                words, n = kept_words(text.as_py(), ranges, length)
                joined = b" ".join(words)
                out.append((n, n - len(words), hashlib.sha256(joined).hexdigest(), joined))
            n, gone, sha, joined = zip(*out, strict=True) if out else ([], [], [], [])
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            if with_text:
                cols.append(pa.array([x.decode() for x in joined], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: len(cols)])

    joined = rows.join(ranges, ["doc", "tkey"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(finish, schema)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), with_text=False)
