"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m), m the least of u and its partners; the sum per u is made before the shuffle."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("_u")).drop("_u")


def _pairs(df: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """A row (u, v) for each of some pairs of columns, from one pass over df."""
    return df.select(F.inline(F.array(*(F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in ends))))


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs -> (node, label), label the least node that can be reached.

    Either step of a round reads and writes the checkpoint folder, so that no plan holds a frame more than twice and the driver's
    memory doesn't grow with plans; rounds end when no edge changes, after about
    the logarithm of the longest path. Null ends and loops are left out; no edges give no rows.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    state = None
    while True:
        large = cut(_least(_pairs(e, ("u", "v"), ("v", "u"))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        e = cut(_pairs(_least(large), ("v", "m"), ("u", "m")).filter("u > v").distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
