"""Hard negatives by product quantisation with stored residual norms.

Components become whole numbers, floor(256 * x). A vector is cut into pieces of ``PIECE`` components; each is stored as the number of its nearest
centroid of that piece's codebook, and the length of what the centroid leaves is stored beside it, rounded up to one byte in units of the row. An anchor's
products with all centroids are a table, so a row's score is estimated by adding one entry for each piece; the products of the anchor's
piece lengths with the stored lengths, added up, bound the error. Centroids are whole numbers, so estimates are exact sums and the bound is rigorous:
a row whose interval can't reach the best is left out, all others get their exact whole-number score, and the answer is that of a search through all rows.

Two searches meet anchors and rows in cells of bounded size. The first finds an anchor's positives: the best rows of its own label. The second
has a window for each positive, from ``low`` to ``high`` hundredths of its score, and completes each window with the best rows of other labels. A cell holds
codes, lengths and two (or four) bytes a component, and returns at most the asked number of rows for each anchor or window, so
what leaves it grows with anchors and cells and never with candidates. Work grows with anchors times rows, as the contract asks; rows are sent once for each block of
anchors, of which there is one for every ``CELL_BYTES`` of anchors.

Codebooks are learnt from at most ``SAMPLE`` rows of a length, in order of a hash of their ids; every row is coded, and a poor codebook only widens bounds.

Rows with a null label or vector, a null or non-finite component, a component beyond ``LIMIT`` / 256 (scores would leave 64 bits) or without an id take no part. Vectors
of different lengths have no product: each length is searched for itself; an empty vector scores 0. Rows that share an id are candidates each, but none for
an anchor of that id, which counts once, with its least label and vector. Ties go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

PIECE = 2
CENTROIDS = 256
ROUNDS = 8
SAMPLE = 4096
LIMIT = 1 << 22
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
CELL_BYTES = 16 << 20
#: Rows of a block at least, and blocks of rows that are made of smaller tables, so that their cells are dealt over tasks; anchors scored at once.
LEAST_ROWS, BLOCKS, AT_ONCE = 2048, 64, 32
CODED = "vec_id long, label long, x binary, code binary, rest binary, unit double, row long"
FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dims, x (whole numbers; an empty vector has one 0) of the rows that take part."""
    v = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), v.cast("array<double>").alias("embedding")).dropna()
    rows = rows.filter(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= F.lit(LIMIT / 256))))
    x = F.transform(v, lambda c: F.floor(c * F.lit(256.0)).cast("int"))
    return rows.select("vec_id", "label", F.size(v).alias("dims"), F.when(F.size(v) == 0, F.array(F.lit(0))).otherwise(x).alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _packed(column: pa.ChunkedArray, kind: str, n: int) -> np.ndarray:
    """(n, values) of a column of equally long byte strings."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(n, -1)


def _nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (np.square(book).sum(axis=1) - 2 * points @ book.T).argmin(axis=1)


def codebooks(sample: np.ndarray) -> list[np.ndarray]:
    """Whole-number centroids for each piece, by Lloyd's rounds from evenly spread different points."""
    books = []
    for at in range(0, sample.shape[1], PIECE):
        points = sample[:, at : at + PIECE].astype(np.float64)
        seen = np.unique(points, axis=0)
        book = seen[np.unique(np.linspace(0, len(seen) - 1, CENTROIDS).astype(int))] if len(seen) else np.zeros((1, points.shape[1]))
        for _ in range(ROUNDS if len(seen) > CENTROIDS else 0):
            own = _nearest(points, book)
            n = np.bincount(own, minlength=len(book))
            sums = np.stack([np.bincount(own, weights=points[:, d], minlength=len(book)) for d in range(points.shape[1])], axis=1)
            book = np.where(n[:, None] > 0, np.rint(sums / np.maximum(n, 1)[:, None]), book)
        books.append(book)
    return books


def encode(rows: DataFrame, dims: int, kind: str, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, x (packed), code (a byte for each piece), rest (bytes; times unit at least the length that the piece's centroid leaves), row (spreads rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), dims)
            code, left = np.empty((len(x), len(books)), dtype=np.uint8), np.empty((len(x), len(books)))
            for m, book in enumerate(books):
                piece = x[:, m * PIECE : (m + 1) * PIECE].astype(np.float64)
                code[:, m] = _nearest(piece, book)
                left[:, m] = np.sqrt(np.square(piece - book[code[:, m]]).sum(axis=1))
            unit = np.maximum(left.max(axis=1, initial=0.0), 1e-3) / 254
            rest = np.ceil(left / unit[:, None]).astype(np.uint8)
            pack = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pack(x.astype(kind)), pack(code), pack(rest), pa.array(unit), batch.column(3)], names=["vec_id", "label", "x", "code", "rest", "unit", "row"])

    return rows.select("vec_id", "label", "x", F.monotonically_increasing_id().alias("row")).mapInArrow(run, CODED)


def intervals(code: np.ndarray, left: np.ndarray, asked: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest score) of every row with each asked vector, one column each: table entries added up, less and plus the bound."""
    score, lengths = np.zeros((len(code), len(asked))), np.empty((len(books), len(asked)))
    for m, book in enumerate(books):
        piece = asked[:, m * PIECE : (m + 1) * PIECE].astype(np.float64)
        score += (book @ piece.T)[code[:, m]]
        lengths[m] = np.sqrt(np.square(piece).sum(axis=1))
    off = left @ lengths * (1 + 1e-9) + 1e-3
    return score - off, score + off


class Block:
    """A block of coded rows."""

    def __init__(self, rows: pa.Table, kind: str):
        n = rows.num_rows
        self.ids, self.labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        self.x, self.code = _packed(rows["x"], kind, n), _packed(rows["code"], "u1", n)
        self.left = _packed(rows["rest"], "u1", n) * rows["unit"].to_numpy()[:, None]

    def exact(self, places: np.ndarray, vector: np.ndarray) -> np.ndarray:
        return self.x[places].astype(np.int64) @ vector.astype(np.int64)

    def best(self, places: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        """Which k of the places have the best scores, ties by id."""
        return np.lexsort((self.ids[places], -score))[:k]


def _columns(parts: list[list[np.ndarray]], names: list[str]) -> pa.Table:
    return pa.table({name: np.concatenate(p) if p else np.zeros(0, dtype=np.int64) for name, p in zip(names, parts, strict=True)})


def positives_in(rows: pa.Table, asked: pa.Table, kind: str, books: list[np.ndarray], k: int) -> pa.Table:
    """anchor_id, positive_id, positive_score: the k best rows of a block with the label of each anchor of another block."""
    out: list[list] = [[], [], []]
    if rows.num_rows and asked.num_rows:
        block, anchors, names, vectors = Block(rows, kind), asked["vec_id"].to_numpy(), asked["label"].to_numpy(), _packed(asked["x"], kind, asked.num_rows)
        for name in np.unique(names):
            same = np.flatnonzero(block.labels == name)
            mine = np.flatnonzero(names == name)
            for some in (mine[at : at + AT_ONCE] for at in range(0, len(mine) if len(same) else 0, AT_ONCE)):
                lows, highs = intervals(block.code[same], block.left[same], vectors[some], books)
                for j, one in enumerate(some):
                    other = block.ids[same] != anchors[one]
                    low, places = lows[other, j], same[other]
                    few = min(k, len(low))
                    if not few:
                        continue
                    reach = np.partition(low, len(low) - few)[len(low) - few]
                    places = places[highs[other, j] >= reach]
                    score = block.exact(places, vectors[one])
                    top = block.best(places, score, k)
                    out[0].append(np.full(len(top), anchors[one]))
                    out[1].append(block.ids[places[top]])
                    out[2].append(score[top])
    return _columns(out, ["anchor_id", "positive_id", "positive_score"])


def negatives_in(rows: pa.Table, asked: pa.Table, kind: str, books: list[np.ndarray], k: int, low: int, high: int) -> pa.Table:
    """FOUND without rank: for each anchor and positive the k best rows of a block with another label whose score lies in the window."""
    out: list[list] = [[], [], [], [], []]
    if rows.num_rows and asked.num_rows:
        block, anchors, names, vectors = Block(rows, kind), asked["vec_id"].to_numpy(), asked["label"].to_numpy(), _packed(asked["x"], kind, asked.num_rows)
        windows = asked["positives"].to_pylist()
        for some in (range(at, min(at + AT_ONCE, len(anchors))) for at in range(0, len(anchors), AT_ONCE)):
            lows, highs = intervals(block.code, block.left, vectors[some.start : some.stop], books)
            for j, one in enumerate(some):
                other = np.flatnonzero((block.labels != names[one]) & (block.ids != anchors[one]))
                least, most = lows[other, j], highs[other, j]
                bounds = [(-(-low * w["score"] // 100), high * w["score"] // 100) for w in windows[one]]
                wanted = np.zeros(len(other), dtype=bool)
                for bottom, top in bounds:
                    sure = least[(least >= bottom) & (most <= top)]
                    reach = np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) >= k else bottom
                    wanted |= (least <= top) & (most >= max(reach, bottom))
                # windows of one anchor overlap, so what any of them wants is reranked once
                near = other[wanted]
                exact = block.exact(near, vectors[one])
                for w, (bottom, top) in zip(windows[one], bounds, strict=True):
                    places, score = near, exact
                    inside = (score >= bottom) & (score <= top)
                    places, score = places[inside], score[inside]
                    chosen = block.best(places, score, k)
                    for c, v in enumerate((np.full(len(chosen), anchors[one]), np.full(len(chosen), w["id"]), block.ids[places[chosen]], np.full(len(chosen), w["score"]), score[chosen])):
                        out[c].append(v)
    return _columns(out, ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])


def _with(meet, *rest):
    return lambda rows, asked: meet(rows, asked, *rest)


def _cells(index: DataFrame, anchors: DataFrame, meet, schema: str, n_rows: int, n_anchors: int, row_bytes: int) -> DataFrame:
    """What ``meet`` returns for each block of rows with each block of anchors."""
    most = max(1, CELL_BYTES // row_bytes)
    row_blocks = max(1, -(-n_rows // most), min(BLOCKS, n_rows // LEAST_ROWS))
    anchor_blocks = max(1, -(-n_anchors // most))
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("rb", spread("row", row_blocks)).withColumn("ab", every(anchor_blocks))
    right = anchors.withColumn("ab", spread("vec_id", anchor_blocks)).withColumn("rb", every(row_blocks))
    return left.groupBy("rb", "ab").cogroup(right.groupBy("rb", "ab")).applyInArrow(meet, schema)


def mine(vectors: DataFrame, asked: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """FOUND: for each row for which ``asked`` holds and each of its best positives, the best negatives within low to high hundredths of the positive's score."""
    rows = valid(vectors)
    parts = []
    greatest = F.array_max(F.transform("x", lambda c: F.abs(c)))
    for r in rows.groupBy("dims").agg(F.count("*").alias("n"), F.count_if(asked).alias("asked"), F.max(greatest).alias("top")).filter("asked > 0 AND n > 1").collect():
        dims, kind = max(1, r["dims"]), "<i2" if r["top"] < 1 << 15 else "<i4"
        own = rows.filter(F.col("dims") == r["dims"])
        sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("x").toArrow()["x"].combine_chunks()
        books = codebooks(_matrix(sample, dims))
        index = cut(encode(own, dims, kind, books))
        anchors = index.filter(asked).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("a")).select("vec_id", "a.label", "a.x")
        size = (r["n"], r["asked"], dims * int(kind[2]) + 2 * len(books) + 40)
        near = _cells(index, anchors, _with(positives_in, kind, books, positives), "anchor_id long, positive_id long, positive_score long", *size)
        rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
        near = near.withColumn("rank", rank).filter(F.col("rank") <= positives)
        windows = near.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("positives"))
        ready = cut(anchors.join(windows, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "x", F.filter("positives", lambda p: p["score"] >= 0).alias("positives")))
        parts.append(_cells(index, ready, _with(negatives_in, kind, books, negatives, low, high), "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long", *size))
    if not parts:
        return vectors.sparkSession.createDataFrame([], FOUND)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    found = reduce(DataFrame.unionByName, parts).withColumn("rank", rank).filter(F.col("rank") <= negatives)
    return found.select(*[c.split()[0] for c in FOUND.split(", ")])


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


OP12_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) > {LIMIT // 256})) = 0
), p AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(coalesce(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * v.e[i])), 0) AS BIGINT) AS score
  FROM v AS a JOIN v ON a.vec_id <> v.vec_id AND len(a.e) = len(v.e) WHERE a.vec_id % 50 = 0
), s AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT s.*, p.vec_id AS negative_id, p.score AS negative_score, CAST(row_number() OVER (PARTITION BY s.anchor_id, positive_id ORDER BY p.score DESC, p.vec_id) AS INTEGER) AS rank
  FROM s JOIN p ON p.anchor_id = s.anchor_id AND NOT p.same AND 50 * positive_score <= 100 * p.score AND 100 * p.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
