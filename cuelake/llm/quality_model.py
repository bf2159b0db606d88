"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms are hashed: the words themselves, their shapes (runs of lower, upper, digit and each sign), and how often words
repeat in three-word windows of the text. A text's term vector is the square root of the terms' shares, weighted
by inverse document frequency; a truncated singular value decomposition of a bounded labelled sample turns it into a
latent-semantic vector of unit length. The sample's vectors and the projection are broadcast: their size is
set by parameters. Every document is compared with all of them in blocks of exact cosine products, and its nearest ones vote
with the square of their similarity, corrected for the share of each label in the sample.

Defined results: null, empty and wordless texts get the share of label 1 in the sample; without labels of both kinds every score is 1
if only label 1 is known or no label, else 0; rows that share a doc_id are scored each for itself; an empty table gives
no rows; a row without an id is not held out. Only doc_id and text, and doc_id and quality of the labels, are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks, labelled
from .common import table

PER_CLASS = 2000
WORDS, SHAPES, REPEATS = 2048, 1024, 4
TERMS = WORDS + SHAPES + REPEATS
#: Weights of the three kinds of terms.
WEIGHTS = (1.0, 1.5, 1.5)
RANK = 48
NEIGHBOURS = 15
CUT = 0.3
#: Bytes of text and number of texts scored at once: a text's terms take 12 KB however short it is.
BLOCK, BLOCK_ROWS = 1 << 20, 1024

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[128:] = ord("a")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def term_shares(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """(texts, TERMS) square roots of the terms' shares, each kind of terms weighted."""
    start, end, bound = blocks.find_words(offsets, data)
    n_docs, n = len(offsets) - 1, np.diff(bound)
    out = np.zeros((n_docs, TERMS), dtype=np.float32)
    if not len(start):
        return out
    doc = np.repeat(np.arange(n_docs), n)
    codes = blocks.byte_codes()
    word = blocks.mix64(blocks.slide(blocks.prefixes(codes[_LOWER[data]]), start, end))
    # shapes: the classes of bytes, with those equal to the one before in the word left out
    kind = _CLASS[data]
    keep = np.ones(len(kind), dtype=bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[start] = True
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    shape = blocks.mix64(blocks.slide(blocks.prefixes(codes[kind[keep]]), kept_before[start], kept_before[end]))
    repeated = np.zeros(len(start), dtype=bool)
    if len(start) > 2:
        prefix = blocks.prefixes(word)
        at = blocks.ragged(bound[:-1], np.maximum(n - 2, 0))
        key = blocks.mix64(blocks.slide(prefix, at, at + 3) + doc[at].astype(np.uint64))
        order = np.argsort(key, kind="stable")
        same = np.zeros(len(key), dtype=bool)
        same[order[1:]] = key[order][1:] == key[order][:-1]
        repeated[at[same]] = True
    twin = np.zeros(len(start), dtype=bool)
    twin[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    share = lambda term, some, size: np.bincount(doc[some] * size + term[some], minlength=n_docs * size).reshape(n_docs, size) / np.maximum(n, 1)[:, None]
    everything = np.ones(len(start), dtype=bool)
    out[:, :WORDS] = WEIGHTS[0] * np.sqrt(share((word % np.uint64(WORDS)).astype(np.int64), everything, WORDS))
    out[:, WORDS : WORDS + SHAPES] = WEIGHTS[1] * np.sqrt(share((shape % np.uint64(SHAPES)).astype(np.int64), everything, SHAPES))
    zero = np.zeros(len(start), dtype=np.int64)
    for k, some in enumerate((repeated, ~repeated, twin, ~twin)):
        out[:, WORDS + SHAPES + k] = WEIGHTS[2] * np.sqrt(share(zero, some, 1)[:, 0])
    return out


@dataclass
class Model:
    project: np.ndarray  # (TERMS, RANK), with the inverse document frequencies
    points: np.ndarray  # (sample, RANK), of unit length
    label: np.ndarray
    weight: np.ndarray  # of each sample row, so that labels weigh as they do among all labels
    prior: float

    def vectors(self, shares: np.ndarray) -> np.ndarray:
        v = shares @ self.project
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, shares: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        out = np.full(len(shares), self.prior)
        some = np.flatnonzero(shares.any(axis=1))
        k = min(neighbours, len(self.label))
        for at in range(0, len(some), 256):
            rows = some[at : at + 256]
            cos = self.vectors(shares[rows]) @ self.points.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cos, near, axis=1), 1e-6) ** 2 * self.weight[near]
            out[rows] = (w * self.label[near]).sum(axis=1) / w.sum(axis=1)
        return out.clip(0, 1)


def decompose(x: np.ndarray, rank: int, seed: int = 5) -> np.ndarray:
    """The first right singular vectors of x, by a randomised range with power steps."""
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(x @ rng.normal(size=(x.shape[1], rank + 10)).astype(np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
    return np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS, rank: int = RANK) -> Model | float:
    """A model from a bounded sample, or the one score to give without labels of both kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offsets, data in blocks.text_blocks(batch.column(0), BLOCK, BLOCK_ROWS):
                rows = []
                for share in term_shares(offsets, data):
                    at = np.flatnonzero(share)
                    rows.append(at.astype("<u4").tobytes() + share[at].astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1).slice(a, b - a)], names=["terms", "label"])

    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).filter(learn)
    count = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    found = labelled.sample(docs, labels, "quality", learn, per_class).select("text", "label").mapInArrow(run, "terms binary, label int").collect()
    found = sorted((r["label"], bytes(r["terms"])) for r in found)
    y = np.array([k for k, _ in found])
    if len(set(y.tolist())) < 2:
        return 0.0 if set(y.tolist()) == {0} else 1.0
    x = np.zeros((len(found), TERMS), dtype=np.float32)
    for row, (_, terms) in zip(x, found, strict=True):
        n = len(terms) // 8
        row[np.frombuffer(terms, "<u4", n)] = np.frombuffer(terms, "<f4", n, 4 * n)
    idf = np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))).astype(np.float32) + 1
    x *= idf
    model = Model(decompose(x, rank), np.zeros((0, rank)), y.astype(np.float64), np.ones(len(y)), 0.0)
    model.points = model.vectors(x)
    model.project = (model.project * idf[:, None]).astype(np.float32)
    model.points = model.points.astype(np.float32)
    for k in (0, 1):
        model.weight[y == k] = count.get(k, 0) / max(1, (y == k).sum())
    model.prior = count.get(1, 0) / max(1, count.get(0, 0) + count.get(1, 0))
    return model


def score(docs: DataFrame, model: Model | float, name: str = "score") -> DataFrame:
    """docs (doc_id, text and more) with the score, a double, under a name; a column of that name is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.full(batch.num_rows, model if isinstance(model, float) else 0.0)
            if not isinstance(model, float):
                for a, b, offsets, data in blocks.text_blocks(batch.column(batch.schema.get_field_index("text")), BLOCK, BLOCK_ROWS):
                    found[a:b] = model.score(term_shares(offsets, data))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, name])

    docs = docs.select(*[c for c in docs.columns if c.lower() != name.lower()])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), labelled.id_crc(5) != 0)
    return score(docs, model).select(
        "doc_id", F.coalesce(labelled.id_crc(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
