"""Labelled rows, all of them or bounded samples: the only data the classifiers fit on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Ids up to which they are broadcast.
FEW_IDS = 1 << 20


def id_crc(modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def sample(docs: DataFrame, labels: DataFrame, column: str, learn: Column, per_class: int) -> DataFrame:
    """(text, label, place) of at most ``per_class`` ids of either label, the first in order of a hash of the id, which is the place.

    ``learn`` says which ids may be learnt from. Ids with several labels count with the greatest, ids with
    several texts with the least text; null ids, labels and texts are left out. The ids are bounded by
    2 * per_class, so they are broadcast.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).filter(learn)
    known = known.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.filter("label = 1").orderBy(*order).limit(per_class).unionByName(known.filter("label = 0").orderBy(*order).limit(per_class))
    found = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).select("text", "label", F.xxhash64("doc_id").alias("place"))


def known(labels: DataFrame, column: str, learn: Column) -> DataFrame:
    """(doc_id, label) of all ids with label 0 or 1 that may be learnt from, computed once; the greatest label counts."""
    some = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).filter(learn)
    return cut(some.groupBy("doc_id").agg(F.max(column).cast("int").alias("label")).filter("label in (0, 1)"))


def texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text, label) of every row with text and a known id."""
    near = F.broadcast(ids) if ids.count() <= FEW_IDS else ids
    return docs.select("doc_id", "text").filter("text is not null").join(near, "doc_id")
