"""Connected components by alternating large-star and small-star contraction; every step is a join or a grouping by vertex."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import durable


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def _to_least(edges: DataFrame) -> DataFrame:
    """Each vertex with the least of itself and its neighbours; combined before the shuffle, so hot vertices are safe."""
    return edges.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))


def components(edges: DataFrame) -> DataFrame:
    """``(vertex, component)`` for every vertex of ``edges(a, b)``: the least vertex that can be reached from it.

    Null ends and loops are ignored; no edges give no rows. Rounds grow with the logarithm of the longest path, and each
    round's edges are written to the shared folder, so lineage stays short. The driver sees a count and a checksum.
    """
    now = durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(_to_least(both), "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v").distinct())
        small = (large.join(_to_least(large), "u")
                 .select(F.explode(F.array(F.struct("u", F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("e"))
                 .select("e.u", "e.v").filter("u <> v").distinct())
        now = durable(small)
        mark, before = _mark(now), mark
        if mark == before:
            break
    leaves = now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
