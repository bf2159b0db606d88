"""Sharding against its contract, on odd rows and hot groups, and the stored map's versions."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cuelake.llm import sharding

ROWS = [(k, f"text {k} " * (k % 7 + 1)) for k in range(300)] + [(None, None), (None, ""), (None, "x"), (5, "one more"), (900, None), (901, "Größe 中文"), (902, "long " * 30_000)]
HOT = [(77, "the same row")] * 4000 + [(None, None)] * 500


def write(spark, folder, rows):
    spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows], "doc_id long, text string, slot string, number string, source string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_query(spark, tmp_path):
    rows = ROWS + HOT
    got = sharding.op13_sharding(spark, write(spark, tmp_path, rows)).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    places, loads = defaultdict(list), Counter()
    for r in got:
        assert 0 <= r.shard < 40 and r.law == "bytes" and r.grown_shard is None
        places[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    # one text is longer than the mean load; the other shards are equal but for a slot's load
    rest = [loads[s] for s in range(40) if loads[s] < 150_000]
    assert len(rest) == 39 and max(rest) - min(rest) < 200


def test_empty_table(spark, tmp_path):
    out = sharding.op13_sharding(spark, write(spark, tmp_path, []))
    assert out.count() == 0 and "shard" in out.columns


def test_places_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 3)
    rows = sharding.records(spark.createDataFrame(ROWS + HOT, "doc_id long, text string"), 8)
    plan = sharding.first_map(spark, 4, 8)
    got = sharding.located(rows, plan).collect()
    order = sorted((r.shard, r.virtual_slot, r.mark, r.slot) for r in got)
    for s in range(4):
        assert [x[3] for x in order if x[0] == s] == list(range(sum(x[0] == s for x in order)))


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "map")
    sizes = spark.range(64).select(F.col("id").cast("int").alias("virtual_slot"), ((F.col("id") * 37) % 101).alias("bytes"))
    sharding.store(sharding.first_map(spark, 5, 64), folder)
    sharding.store(sharding.rebalanced(sharding.stored(spark, folder), sizes, 5), folder)
    sharding.store(sharding.grown(sharding.stored(spark, folder), sizes, 5), folder)
    maps = [{r.virtual_slot: r.shard for r in sharding.stored(spark, folder, v).collect()} for v in (1, 2, 3)]
    assert {r.virtual_slot: r.shard for r in sharding.stored(spark, folder).collect()} == maps[2]
    assert [sorted(m) for m in maps] == [list(range(64))] * 3
    assert maps[0] == {k: k % 5 for k in range(64)}
    weight = {r.virtual_slot: r.bytes for r in sizes.collect()}
    load = lambda m: Counter({s: sum(weight[k] for k in m if m[k] == s) for s in set(m.values())})
    assert max(load(maps[1]).values()) - min(load(maps[1]).values()) <= 20
    assert sum(maps[0][k] == maps[1][k] for k in range(64)) > 32  # an edit, no new deal
    moved = {k for k in range(64) if maps[2][k] != maps[1][k]}
    assert moved and all(maps[2][k] == 5 for k in moved)
    assert 0.5 * sum(weight.values()) / 6 < load(maps[2])[5] <= sum(weight.values()) / 6


@pytest.mark.parametrize("shards", [1, 3])
def test_few_slots(spark, shards):
    sizes = spark.createDataFrame([(0, 10)], "virtual_slot int, bytes long")
    plan = sharding.rebalanced(sharding.first_map(spark, shards, 2), sizes, shards)
    assert sorted((r.virtual_slot, r.version) for r in plan.collect()) == [(0, 2), (1, 2)]
    assert all(0 <= r.shard < shards for r in plan.collect())
