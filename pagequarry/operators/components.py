"""Connected components of an edge list, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.session import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """(node, component): component is the smallest node of the class. Nodes without an edge do not appear.

    Each round links the larger neighbours of a node to its smallest neighbour (large star), then its smaller
    neighbours to the smallest (small star); rounds grow with the logarithm of the longest path. Each round is a
    pair of aggregations over distinct edges, cut by a checkpoint; only a sum comes to the driver.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter("u != v").distinct()
    e = cut(e)
    before = None
    for _ in range(max_rounds):
        # large star: each node u tells its larger neighbours the smallest of its neighbours and itself
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # small star: each node links its smaller neighbours, and itself, to the smallest of them
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small_least, "u")
        e = cut(linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(linked.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
        now = e.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(
        roots.join(e.select(F.col("u").alias("node")), "node", "left_anti")
    )
