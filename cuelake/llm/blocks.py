"""Texts as Arrow buffers: words and their hashes, found for a whole block of documents at once.

A block is a slice of an Arrow string column of at most about ``BLOCK_BYTES`` of
text (one text, if that is longer). Its words are found on the raw UTF-8 bytes:
space and the controls 9 to 13 never occur inside a multi-byte character.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20

U64 = np.uint64
#: Odd multiplier of the rolling hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that low and high bits depend on all others."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


@lru_cache(maxsize=1)
def byte_codes() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(max(n, 1 << 12), base, dtype=U64)
            have[0] = 1
            have = np.multiply.accumulate(have)
        if n <= 2 * BLOCK_BYTES:
            _POWERS[base] = have
    return have[:n]


def slide(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), from ``prefix`` made by ``prefixes``."""
    return (prefix[end] - prefix[start]) * powers(BASE, len(prefix))[start]


def prefixes(values: np.ndarray) -> np.ndarray:
    """Prefix sums that let ``slide`` hash any span of ``values`` alike wherever it stands."""
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * powers(BASE_INV, len(values)), out=out[1:])
    return out


def text_blocks(column: pa.Array | pa.ChunkedArray, most: int | None = None, rows: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, offsets into bytes, bytes) of blocks; null texts are empty."""
    most = BLOCK_BYTES if most is None else most
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if column.type != pa.string():
        column = column.cast(pa.string())
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), n, at + (rows or n))
        yield at, to, offsets[at : to + 1] - offsets[at], raw[offsets[at] : offsets[to]]
        at = to


def find_words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start bytes, end bytes, number of words of each text before it and in all) of a block."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    word = ~IS_SPACE[data]
    begins = np.empty(n, dtype=bool)
    begins[0] = True
    np.logical_not(word[:-1], out=begins[1:])
    bounds = offsets[:-1]
    begins[bounds[bounds < n]] = True
    begins &= word
    ends = np.empty(n, dtype=bool)
    ends[-1] = True
    np.logical_not(word[1:], out=ends[:-1])
    last = offsets[1:] - 1
    ends[last[last >= 0]] = True
    ends &= word
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words given by their bytes."""
    if not len(start):
        return np.zeros(0, dtype=U64)
    prefix = prefixes(byte_codes()[data])
    return mix64(slide(prefix, start, end) + (end - start).astype(U64))


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0] .. first[0]+count[0]-1, first[1] .. and so on, in one array."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(count)
    return np.arange(total, dtype=np.int64) + np.repeat(first - (ends - count), count)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, for code that makes Python objects of them."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Returns freed memory to the system: Python workers outlive their tasks, and what they keep adds up over the stages of a job."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over the batches of a partition that gives memory back when it ends."""

    @wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied
