"""A training corpus from documents: the stages in order, each written and read again as the next one's input.

Every stage gets all rows that the one before kept, and all but the last return the columns of documents. A row without text is kept
by the filters and counts as empty. Rows that share a doc_id are rows of their own, but near-duplicate
removal keeps one of those whose texts are equal. Columns beyond those of documents pass through all stages but the last, whatever
their names; empty tables give empty tables.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import labelled, lines, mixing, near_copies, packing, toxicity
from cuelake.llm.common import delete_folder, ensure_checkpoint_dir, spare, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under the cut, by a model that learns from the labels of the input's documents."""
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.fit(docs, labels, labelled.id_crc(3) != 1)
    (score,) = spare(docs.columns, "score")
    return toxicity.score(docs, model, score).filter(F.col(score) < toxicity.CUT).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the first of each class of equal or nearly equal lines left."""
    return lines.dedup_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingle sets with a similarity of 0.8 or more, every such pair.

    SimHash links fingerprints within three bits first, confirmed by the sets; as that misses most of those pairs (README has figures), an exact join finds the rest.
    """
    return near_copies.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask."""
    return mixing.emit(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: Training, hashing and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from all documents. A stage's output goes once the next one's is written; the last one's stays, as the result reads it."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            delete_folder(spark, before)
        before = out
    return docs
