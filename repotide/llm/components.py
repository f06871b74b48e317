"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repotide.session import cut, release


def connected(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of ``edges`` (u, v) that has an edge; the root is the component's least node.

    Each round is two joins on node ids: every neighbour is hooked to the least node around. Rounds grow with
    the logarithm of a component's width. Nothing is gathered by node, so a hub with a third of all edges is
    an aggregate with partial sums and a join whose partitions adaptive execution splits.
    """
    now = cut(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (seen["n"], seen["x"]) == mark:
            break
        mark = (seen["n"], seen["x"])
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(below, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        new = cut(moved.unionByName(below.withColumnRenamed("m", "v")).distinct())
        release(now)
        now = new
    roots = now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct()
    return now.withColumnRenamed("v", "root").unionByName(roots).distinct()
