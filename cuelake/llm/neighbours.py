"""Nearest neighbours with randomly rotated one-bit codes.

A vector, less the centroid, is scaled to unit length, rotated by a seeded random orthogonal matrix and kept as the signs of its
components, packed, with two scalars: its distance from the centroid and its inner product with its own code. A query, turned
likewise, is cut into bit planes of ``PLANES`` bits a component, so that its inner product with a code is a sum of bit counts over packed words.
From it and the scalars the inner product with the vector is estimated without bias, and the error is bounded by
``epsilon`` standard deviations and what the planes leave out; the exact distance is computed only for vectors whose bound reaches the k-th best found.

The stated queries meet all rows in cells of a block of rows and a block of queries, of at most ``CELL_BYTES`` of vectors each, so
memory stays bounded while the number of cells grows with rows times queries. A row is sent once for each block of queries and a query
once for each block of rows, with its vector: at 64 components the bounds let through a few hundredths of all rows for each query, so over a
block of queries nearly every vector is wanted. Each cell returns its k best per query; a window takes the k best of those.

Vectors that are null, zero, or hold null or non-finite components, and rows without an id, take no part. Vectors of different lengths have
no distance: each length is searched for itself. Rows that share an id are candidates each; as a query the id counts once for each length, with its least
vector, and none of its rows is a candidate for it. Ties go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

K = 10
EPSILON = 3.5
PLANES = 6
CELL_BYTES = 16 << 20
#: Rows of a block at least, and blocks of rows that are made of smaller tables, so that their cells are dealt over tasks.
LEAST_ROWS, BLOCKS = 2048, 64
CODED = "vec_id long, embedding array<double>, code binary, norm double, inner double, row long"
FOUND = "query_id long, rank int, vec_id long, score double"


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (double) of the rows that take part."""
    x = F.col("embedding")
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), x.cast("array<double>").alias("embedding"))
    return rows.filter(F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, fine) & F.exists(x, lambda v: v != 0))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def rotation(dims: int, seed: int = 11) -> np.ndarray:
    """(dims, width) with orthogonal rows, width the next multiple of 64."""
    width = -(-dims // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, width)))
    return (q * np.sign(np.diag(r)))[:dims]


def centroid(vectors: DataFrame, dims: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims), 0
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            total, n = total + x.sum(axis=0, dtype=np.float64), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(total), pa.array(np.full(dims, n))], names=["d", "s", "n"])

    sums = vectors.select("embedding").mapInArrow(run, "d int, s double, n long").groupBy("d").agg((F.sum("s") / F.sum("n")).alias("m"))
    out = np.zeros(dims)
    for r in sums.collect():
        out[r["d"]] = r["m"] or 0.0
    return out if np.isfinite(out).all() else np.zeros(dims)


def encode(vectors: DataFrame, centre: np.ndarray, turn: np.ndarray) -> DataFrame:
    """vec_id, embedding, code (packed signs), norm (distance from the centre), inner (of the unit vector with its code), row (a number that spreads rows)."""
    dims, width = turn.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dims) - centre
            norm = np.linalg.norm(x, axis=1)
            y = x / np.where(norm > 0, norm, 1)[:, None] @ turn
            code = np.packbits(y > 0, axis=1)
            inner = np.where(norm > 0, np.abs(y).sum(axis=1) / width**0.5, 1.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm), pa.array(inner), batch.column(2)],
                names=["vec_id", "embedding", "code", "norm", "inner", "row"],
            )

    return vectors.select("vec_id", "embedding", F.monotonically_increasing_id().alias("row")).mapInArrow(run, CODED)


def euclidean(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distances in double precision, components added in their order."""
    total = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        total += (rows[:, d] - query[d]) ** 2
    return np.sqrt(total)


def planes(query: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(packed bits of the components' steps, plane by plane; lowest component; size of a step) of a turned query."""
    low = float(query.min())
    step = max(float(query.max()) - low, 1e-12) / ((1 << PLANES) - 1)
    steps = np.rint((query - low) / step).astype(np.uint16)
    bits = (steps[None, :] >> np.arange(PLANES, dtype=np.uint16)[:, None] & 1).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.uint64), low, step


def products(code: np.ndarray, ones: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, float]:
    """(inner products of a turned query with sign codes given as packed words, from bit counts; by how much they can be off)."""
    bits, low, step = planes(query)
    width = code.shape[1] * 64
    total = np.zeros(len(code))
    for j in range(PLANES):
        total += np.bitwise_count(code & bits[j]).sum(axis=1, dtype=np.int64) * float(1 << j)
    return (2 * (low * ones + step * total) - query.sum()) / width**0.5, step / 2 * width**0.5


def cell(rows: pa.Table, asked: pa.Table, centre: np.ndarray, turn: np.ndarray, k: int, epsilon: float) -> pa.Table:
    """query_id, vec_id, score: the k nearest that a block of queries finds in a block of coded rows."""
    dims, width = turn.shape
    found: list[list] = [[], [], []]
    if rows.num_rows and asked.num_rows:
        ids = rows["vec_id"].to_numpy()
        x = _matrix(rows["embedding"].combine_chunks(), dims)
        code = np.frombuffer(b"".join(rows["code"].to_pylist()), dtype=np.uint64).reshape(len(ids), -1)
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        norm, inner = rows["norm"].to_numpy(), np.maximum(rows["inner"].to_numpy(), 1e-6)
        slack = epsilon * np.sqrt(np.maximum(1 - inner**2, 0)) / inner / max(width - 1, 1) ** 0.5
        q_ids = asked["vec_id"].to_numpy()
        q = _matrix(asked["embedding"].combine_chunks(), dims)
        for one, vector in enumerate(q):
            r = vector - centre
            r_norm = float(np.linalg.norm(r))
            product, off = products(code, ones, r / (r_norm or 1.0) @ turn)
            own = ids != q_ids[one]
            base, scale = norm**2 + r_norm**2, 2 * norm * r_norm
            guess = np.where(own, base - scale * (product / inner), np.inf)
            lowest = np.where(own, base - scale * np.minimum((product + off) / inner + slack, 1), np.inf)
            few = min(k, int(own.sum()))
            if not few:
                continue
            start = np.argpartition(guess, few - 1)[:few]
            reach = euclidean(vector, x[start]).max()
            again = np.union1d(np.flatnonzero(lowest <= reach**2 * (1 + 1e-6) + 1e-9), start)
            exact = euclidean(vector, x[again])
            best = np.lexsort((ids[again], exact))[:k]
            found[0].append(np.full(len(best), q_ids[one]))
            found[1].append(ids[again][best])
            found[2].append(exact[best])
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
    return pa.table({"query_id": cat(found[0], np.int64), "vec_id": cat(found[1], np.int64), "score": cat(found[2], np.float64)})


def search(index: DataFrame, queries: DataFrame, centre: np.ndarray, turn: np.ndarray, k: int = K, epsilon: float = EPSILON, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """query_id, vec_id, score: for each cell and query the k nearest found. index: from encode; queries: vec_id, embedding, ids different."""
    n_rows, n_queries = index.count(), queries.count()
    most = max(1, cell_bytes // (8 * turn.shape[0]))
    row_blocks = max(1, -(-n_rows // most), min(BLOCKS, n_rows // LEAST_ROWS))
    query_blocks = max(1, -(-n_queries // most))
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("rb", spread("row", row_blocks)).withColumn("qb", every(query_blocks))
    right = queries.withColumn("qb", spread("vec_id", query_blocks)).withColumn("rb", every(row_blocks))
    meet = lambda rows, asked: cell(rows, asked, centre, turn, k, epsilon)
    return left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(meet, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, asked: Column, k: int = K, epsilon: float = EPSILON, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row for which ``asked`` holds, among all other rows of its length."""
    rows = valid(vectors)
    parts = []
    for r in rows.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n"), F.max(asked).alias("asked")).filter("asked AND n > 1").select("dims").collect():
        dims = r["dims"]
        own = rows.filter(F.size("embedding") == dims)
        centre, turn = centroid(own, dims), rotation(dims)
        index = cut(encode(own, centre, turn))
        queries = cut(own.filter(asked).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
        parts.append(search(index, queries, centre, turn, k, epsilon, cell_bytes))
    if not parts:
        return vectors.sparkSession.createDataFrame([], FOUND)
    near = reduce(DataFrame.unionByName, parts)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 100 == 0)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (v.e[i] - q.e[i]) * (v.e[i] - q.e[i])), lambda a, b: a + b)) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
