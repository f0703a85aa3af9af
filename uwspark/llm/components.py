"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from uwspark.staging import stage


def _check(edges: DataFrame) -> tuple:
    """Row count and checksum: two numbers, whatever the size of the table."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node that is not the smallest of its component with that smallest node.

    `edges` has columns u and v of one orderable type; direction, repeats and loops do
    not matter.  Each round moves every neighbour towards the smallest one it knows and
    ends as a written table; the rounds grow with the logarithm of the longest path.
    """
    now = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _check(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        check = _check(after)
        if check == seen:
            return after
        now, seen = after, check
