"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("xxhash64(u, v) & 1048575"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (u, v); root is the least node of its component.

    Each round attaches neighbours to their least neighbour, first those that are larger, then
    those that are smaller than a node; the number of rounds grows with the logarithm of a
    component's diameter. Minima are combined before the shuffle; each round is checkpointed.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    e = C.cut(e)
    before = _mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = C.cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = _mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
