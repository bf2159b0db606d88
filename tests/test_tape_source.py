"""The tape format: the same blocks for any cutting, as a table and as a stream; WAV headers; the sink's commit."""

from __future__ import annotations

import random
import struct
from pathlib import Path

import numpy as np
import pytest

from cuelake.sources import tapes

BLOCK = 1000


def lay(folder: Path, name: int, raw: bytes, rng: random.Random, sizes=(1, 2, 3, 501, 1999, 4096)):
    (folder / str(name)).mkdir(parents=True)
    at = k = 0
    while at < len(raw):
        n = rng.choice(sizes)
        (folder / str(name) / f"{k:06d}.pcm").write_bytes(raw[at : at + n])
        at, k = at + n, k + 1


def wav(x: np.ndarray, extra: bytes = b"", channels=1) -> bytes:
    raw = x.astype("<i2").tobytes()
    note = (b"LIST" + struct.pack("<I", len(extra)) + extra + b"\0" * (len(extra) % 2)) if extra else b""
    return b"RIFF" + struct.pack("<I", 36 + len(note) + len(raw)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, 8000, 16000, 2, 16) + note + b"data" + struct.pack("<I", len(raw)) + raw


def samples():
    rng = np.random.default_rng(3)
    return {1: rng.integers(-9000, 9000, 12_345), 2: rng.integers(-9, 9, 1000), 3: rng.integers(-9, 9, 700), -4: rng.integers(-9, 9, 2000)}


def want(x):
    return [(k, k * BLOCK, x[k * BLOCK : (k + 1) * BLOCK].astype("<i2").tobytes()) for k in range(-(-len(x) // BLOCK))]


def got(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.tape, r.block)):
        out.setdefault(r.tape, []).append((r.block, r.base, bytes(r.pcm)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_any_cutting_gives_the_same_blocks(spark, tmp_path, seed):
    tapes.register(spark)
    rng, tape = random.Random(seed), samples()
    for name, x in tape.items():
        raw = wav(x, b"note") if name in (1, 3) else x.astype("<i2").tobytes() + b"\x07" * (name == 2)
        lay(tmp_path, name, raw, rng)
    (tmp_path / "9").mkdir()
    (tmp_path / "9" / "_end").touch()
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "a.pcm").write_bytes(b"abcd")
    df = spark.read.format("tape").option("block", BLOCK).option("partition", 5000).load(str(tmp_path))
    assert df.rdd.getNumPartitions() > len(tape)
    assert got(df.collect()) == {k: want(x) for k, x in tape.items()}


def test_a_stream_gives_the_blocks_of_the_table(spark, tmp_path):
    tapes.register(spark)
    src, tape = tmp_path / "in", samples()
    stream = spark.readStream.format("tape").option("block", BLOCK).load(str(src))
    raw = {k: x.astype("<i2").tobytes() for k, x in tape.items()}
    seen = []
    for step in range(4):
        for k, b in raw.items():
            (src / str(k)).mkdir(parents=True, exist_ok=True)
            n = len(b)
            edge = [0, n // 3 | 1, n // 2, n * 3 // 4 | 1, n]
            (src / str(k) / f"{step}.pcm").write_bytes(b[edge[step] : edge[step + 1]])
            if step == 3:
                (src / str(k) / "_end").touch()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        seen.append(spark.read.parquet(str(tmp_path / "out")).count())
    assert got(spark.read.parquet(str(tmp_path / "out")).collect()) == {k: want(x) for k, x in tape.items()}
    assert seen == sorted(seen) and len(set(seen)) == 4


def test_other_wav_files_are_refused(spark, tmp_path):
    tapes.register(spark)
    lay(tmp_path, 1, wav(np.zeros(10), channels=2), random.Random(1))
    with pytest.raises(Exception, match="not_pcm"):
        spark.read.format("tape").load(str(tmp_path)).collect()


def test_the_sink_and_back(spark, tmp_path):
    tapes.register(spark)
    rng = random.Random(5)
    raw = {k: bytes(rng.randrange(256) for _ in range(n)) for k, n in ((1, 30_001), (2, 4_000), (3, 0))}
    rows = [(k, at, b[at : at + 77]) for k, b in raw.items() for at in range(0, len(b), 77)]
    rng.shuffle(rows)
    out = str(tmp_path / "tapes")
    df = spark.createDataFrame(rows, "tape long, at long, bytes binary").repartitionByRange(4, "tape", "at").sortWithinPartitions("tape", "at")
    df.write.format("tape").mode("append").save(out)
    back = got(spark.read.format("tape").option("block", BLOCK).load(out).collect())
    assert {k: b"".join(p for _, _, p in v) for k, v in back.items()} == {k: b[: len(b) // 2 * 2] for k, b in raw.items() if b}
    with pytest.raises(Exception, match="appended"):
        df.write.format("tape").mode("overwrite").save(out)
    assert not [p for p in Path(out).rglob(".*") if p.suffix != ".crc"]
    assert spark.read.format("tape").load(str(tmp_path / "none")).count() == 0


def test_levels_cues_and_words_of_a_stream_are_those_of_the_table(spark, tmp_path):
    from cuelake.streaming import tape as T

    tapes.register(spark)
    rng = np.random.default_rng(8)
    said = [rng.normal(0, a, n) for _ in range(12) for a, n in ((6000, 5000), (20, 1500), (5000, 3000), (15, 900))]
    tape = {1: np.concatenate(said).astype(int), 2: np.zeros(9000, dtype=int), 3: np.concatenate(said[:9])[:20_011].astype(int)}
    cues = [(k, i, i * 1.3 + 0.1, i * 1.3 + 1.35, "men keldim" if i % 2 else "men bugun maktabga keldim") for k in tape for i in range(8)]
    cues = spark.createDataFrame(cues, "tape long, idx long, s double, e double, text string")
    whole = spark.createDataFrame([(k, 0, x.astype("<i2").tobytes()) for k, x in tape.items()], "tape long, base long, pcm binary")
    table = T.levels(whole, 160)
    for k, x in tape.items():
        lay(tmp_path / "in", k, x.astype("<i2").tobytes(), random.Random(k), (999, 4096, 17))
    for block in (77, 8000):
        folder = str(tmp_path / str(block))
        stream = lambda b=block: spark.readStream.format("tape").option("block", b).load(str(tmp_path / "in"))
        T.collecting(stream(), 160, f"{folder}/parts", f"{folder}/ck").awaitTermination()
        if block == 77:
            tapes.end(str(tmp_path / "in"))
        T.collecting(stream(), 160, f"{folder}/parts", f"{folder}/ck").awaitTermination()
        found = T.collected(spark, f"{folder}/parts", 160)
        rows = lambda df: sorted(map(tuple, df.collect()))
        assert rows(found) == rows(table)
        assert rows(T.curve(found, 160)) == rows(T.curve(table, 160))
        assert rows(T.aligned_levels(found, cues.drop("text"), 160)) == rows(T.aligned_blocks(whole, cues.drop("text"), 160))
        assert rows(T.words_levels(found, cues, 160)) == rows(T.words_blocks(whole, cues, 160))
    assert any(r.moved for r in T.aligned_levels(table, cues.drop("text"), 160).collect())
    assert {m for r in T.words_levels(table, cues, 160).collect() for m in r.methods} >= {"valley"}


def test_histograms_of_parts_add_up(spark):
    from cuelake.operators import signal

    rng = random.Random(2)
    rows = [(k % 3, k, rng.choice([0.1, 0.2, 0.3, 0.0, rng.random()])) for k in range(500)]
    levels = spark.createDataFrame(rows, "tape long, f int, level double")
    parts = [signal.histogram(levels.filter(f"f % 4 = {k}")) for k in range(4)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    got = sorted(map(tuple, signal.gates_of(signal.merged(both)).collect()))
    assert got == sorted(map(tuple, signal.gates(levels).collect()))
    for r in signal.gates(levels).collect():
        own = sorted(x for t, _, x in rows if t == r.tape)
        assert r.noise_floor == own[round(0.1 * (len(own) - 1))] and r.frames == len(own)


def test_an_empty_stream(spark, tmp_path):
    from cuelake.streaming import tape as T

    tapes.register(spark)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.format("tape").load(str(tmp_path / "in"))
    T.collecting(stream, 160, str(tmp_path / "parts"), str(tmp_path / "ck")).awaitTermination()
    assert T.curve(T.collected(spark, str(tmp_path / "parts"), 160), 160).count() == 0
