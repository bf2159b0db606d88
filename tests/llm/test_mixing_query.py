"""op8_mixing: equal rows have draws of their own, many sources, clashing names; op1_neighbours: doubles, lengths, recall over several cells."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.llm import mixing, neighbours


def _against_sql(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).write.parquet(str(folder / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = Counter(tuple(r) for r in mixing.op8_mixing(spark, str(folder)).collect())
    assert got == Counter(con.sql(mixing.OP8_SQL).fetchall())
    return got


def test_equal_rows_draw_for_themselves(spark, tmp_path):
    rows = [(None, "a b c", "x")] * 400 + [(1, "d e", "x")] * 300 + [(k, "one two three four", "y") for k in range(10, 310)] + [(None, None, None), (5, "", "z"), (5, None, "z")]
    got = _against_sql(spark, tmp_path, rows)
    taken = Counter()
    for (i, size, _, _, words), n in got.items():
        taken[i if i in (None, 1) else 2, words // max(size, 1)] += n
    target = {r[3] for r in got if r[0] == 1}.pop()
    rate = target / 1800
    for who, n in ((None, 400), (1, 300)):
        copies = sum(c * k for (w, c), k in taken.items() if w == who)
        assert abs(copies - n * rate) < 4 * (n * 0.25) ** 0.5 + 2


def test_many_sources(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * rng.randint(0, 30)), rng.choice([None, f"source {rng.randint(0, 700)}", f"é{rng.randint(0, 50)}", ""])) for k in range(3000)]
    _against_sql(spark, tmp_path, rows)


def test_clashing_names_pass_through(spark):
    rows = [(k, "a b c d", f"s{k % 2}", k, "r", "t", "c", "q", "u") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, rate string, target string, copies string, source_size string, _copy string")
    out = mixing.emit(docs)
    assert out.columns == docs.columns
    assert set(map(tuple, out.collect())) <= set(rows)
    assert mixing.emit(docs.limit(0)).count() == 0


def test_neighbours_in_double_and_by_length(spark):
    rows = [(k, [1e39 * k, 1.0 + 1e-12 * k]) for k in range(1, 40)] + [(100 + k, [1.0 + 1e-12 * k, 0.5]) for k in range(30)] + [(200, [1.0, 2.0, 3.0]), (201, [1.0, 2.0, 4.0]), (300, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert [i for i, _ in got[100]] == [101, 102, 103]
    assert got[100][0][1] == (1.0 + 1e-12) - 1.0
    assert got[200] == [(201, 1.0)] and 300 not in got


@pytest.mark.parametrize("dims", [48, 64, 130])
def test_recall_over_cells(spark, dims):
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(40, dims))
    x = np.float32(centres[rng.integers(0, 40, 6000)] + 0.7 * rng.normal(size=(6000, dims)))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0, 10, cell_bytes=8 * dims * 700).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit, y = 0, x.astype(float)
    for q in range(0, 6000, 100):
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hit += len(got[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hit >= 0.99 * 600


def test_products_from_bit_counts():
    rng = np.random.default_rng(1)
    for width in (64, 128):
        signs = rng.integers(0, 2, (50, width))
        code = np.packbits(signs.astype(np.uint8), axis=1).view(np.uint64)
        q = rng.normal(size=width)
        q /= np.linalg.norm(q)
        found, off = neighbours.products(code, np.bitwise_count(code).sum(axis=1, dtype=np.int64), q)
        assert np.abs(found - (signs * 2 - 1) @ q / width**0.5).max() <= off
