"""Tapes as a data source: ``spark.read.format("tape")``, ``spark.readStream.format("tape")`` and ``df.write.format("tape")``.

A tape is a folder of files, ``<path>/<tape>/<name>``, that hold its bytes in the order of their names, cut anywhere, also inside a
sample; names that begin with a dot or an underscore are left out. It is raw PCM (16 bits, little-endian, one channel), or, if it begins with a RIFF
header, the data chunk of a WAV file of that form. Rows are blocks of ``block`` samples: tape, block, base (number of its first
sample), pcm. Partitions are ranges of blocks of at most ``partition`` bytes, found from the sizes of files alone, so one tape of
any length is read by many tasks; a block reads its range of bytes across files, and so the cutting never shows. A byte that is half a sample at a
tape's end is left out.

As a stream, an offset is the number of blocks of each tape that can be read. A block is read once it is whole, and the last one of a tape, which may
be short, once the tape holds a file named ``_end``; so a stream gives the blocks that a read of the whole folder gives.

As a sink it takes rows tape (long), at (long) and bytes (binary), sorted by tape and at within each partition (at of no two partitions
of a tape may interleave): each task writes one file a tape, named by its first ``at``, under a hidden name until the job commits.

Paths are local or shared ones, or URIs that ``pyarrow.fs`` can open.
"""

from __future__ import annotations

import struct
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "tape long, block long, base long, pcm binary"
BLOCK, PARTITION = 60 * 8000, 64 << 20
#: Bytes read at once.
READ = 1 << 20
#: Bytes in which the header of a WAV file has to begin its data.
HEADER = 1 << 16


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/"):
        path = path[5:].replace("///", "/", 1)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _ranges(store: fs.FileSystem, files: list[tuple[str, int]], a: int, b: int) -> bytes:
    """The bytes [a, b) of files, one after another."""
    ends = list(accumulate(size for _, size in files))
    out, k = [], bisect_right(ends, a)
    while a < b and k < len(files):
        begin = ends[k] - files[k][1]
        with store.open_input_file(files[k][0]) as f:
            part = f.read_at(min(b, ends[k]) - a, a - begin)
        out.append(part)
        a, k = ends[k], k + 1
    return b"".join(out)


def data_span(store: fs.FileSystem, files: list[tuple[str, int]]) -> tuple[int, int]:
    """(first byte, end) of a tape's samples: all bytes, or the data chunk of a WAV file, as far as the files go. ValueError with a code for other WAV files."""
    total = sum(size for _, size in files)
    head = _ranges(store, files, 0, min(total, HEADER))
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return 0, total
    at = 12
    while at + 8 <= len(head):
        name, size = head[at : at + 4], struct.unpack_from("<I", head, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(head) and struct.unpack_from("<HH", head, at + 8) + struct.unpack_from("<H", head, at + 22) != (1, 1, 16):
            raise ValueError("not_pcm")
        if name == b"data":
            return at + 8, min(total, at + 8 + size)
        at += 8 + size + size % 2
    raise ValueError("bad_header")


@dataclass
class Tape:
    name: int
    files: list[tuple[str, int]]
    first: int
    end: int
    ended: bool

    def blocks(self, block: int, whole: bool) -> int:
        """How many blocks there are; ``whole``: without a last one that may still grow."""
        samples = (self.end - self.first) // 2
        return samples // block if whole and not self.ended else -(-samples // block)


def tapes(path: str) -> list[Tape]:
    """The tapes of a folder, by number; folders whose name is no number are left out."""
    store, root = opened(path)
    found: dict[int, list] = {}
    for f in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        parts = f.path[len(root.rstrip("/")) :].strip("/").split("/")
        if f.type == fs.FileType.File and len(parts) == 2 and parts[0].lstrip("-").isdigit():
            found.setdefault(int(parts[0]), []).append((parts[1], f.path, f.size))
    out = []
    for name, files in sorted(found.items()):
        real = [(p, size) for n, p, size in sorted(files) if n[0] not in "._"]
        if real:
            out.append(Tape(name, real, *data_span(store, real), any(n == "_end" for n, _, _ in files)))
    return out


def end(path: str, *names: int) -> None:
    """Marks tapes as ended, or all tapes of a folder if none is named."""
    store, root = opened(path)
    for name in names or [t.name for t in tapes(path)]:
        store.open_output_stream(f"{root}/{name}/_end").close()


class Range(InputPartition):
    """Blocks [a, b) of a tape and the files that hold them."""

    def __init__(self, tape: Tape, a: int, b: int):
        self.tape, self.a, self.b = tape, a, b


class _Blocks:
    def __init__(self, options: dict):
        self.path = options.get("path") or ""
        self.block = int(options.get("block", BLOCK))
        self.most = max(1, int(options.get("partition", PARTITION)) // (2 * self.block))
        if not self.path or self.block < 1:
            raise ValueError("a path and a block of at least one sample are needed")

    def ranges(self, tape: Tape, a: int, b: int) -> list[Range]:
        return [Range(tape, k, min(b, k + self.most)) for k in range(a, b, self.most)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there is no partition
            return
        store, _ = opened(self.path)
        t = partition.tape
        size = 2 * self.block
        step = max(1, READ // size)
        for a in range(partition.a, partition.b, step):
            # many short blocks are one read and one batch
            numbers = range(a, min(a + step, partition.b))
            first = t.first + size * a
            held = _ranges(store, t.files, first, min(first + size * len(numbers), t.end - (t.end - t.first) % 2))
            pcm = [held[at : at + size] for at in range(0, size * len(numbers), size)]
            cols = [pa.array(x, kind) for x, kind in (([t.name] * len(pcm), pa.int64()), (numbers, pa.int64()), ([k * self.block for k in numbers], pa.int64()), (pcm, pa.binary()))]
            yield pa.RecordBatch.from_arrays(cols, names=["tape", "block", "base", "pcm"])


class TapeReader(_Blocks, DataSourceReader):
    def partitions(self) -> list[Range]:
        return [r for t in tapes(self.path) for r in self.ranges(t, 0, t.blocks(self.block, False))]


class TapeStreamReader(_Blocks, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {str(t.name): t.blocks(self.block, True) for t in tapes(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        known = {str(t.name): t for t in tapes(self.path)}
        return [r for name, b in end.items() if name in known for r in self.ranges(known[name], start.get(name, 0), b)]

    def commit(self, end: dict) -> None:
        """Files stay."""


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class TapeWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("tapes are appended to; give a new path instead of overwriting one")
        self.path = options["path"].rstrip("/")

    def write(self, rows: Iterator) -> Written:
        store, root = opened(self.path)
        files, now, out = [], None, None
        try:
            for row in rows:
                if row["tape"] != now:
                    if out:
                        out.close()
                    now, folder = row["tape"], f"{root}/{row['tape']}"
                    store.create_dir(folder)
                    hidden = f"{folder}/.{uuid.uuid4().hex}"
                    files.append((hidden, f"{folder}/{row['at']:020d}.pcm"))
                    out = store.open_output_stream(hidden)
                out.write(bytes(row["bytes"]))
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = opened(self.path)
        for m in messages:
            for hidden, name in m.files if m else []:
                store.move(hidden, name)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = opened(self.path)
        for m in messages:
            for hidden, _ in m.files if m else []:
                store.delete_file(hidden)


class TapeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tape"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TapeReader:
        return TapeReader(self.options)

    def streamReader(self, schema) -> TapeStreamReader:
        return TapeStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> TapeWriter:
        return TapeWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(TapeSource)
