"""Connected components of edges held in Spark, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyset.llm.common import drop_staged, staged


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b of one orderable type: longs, or structs); component: its smallest node.

    Each round hangs neighbours under the smallest node in reach; edges never grow in number, and a
    star forest is left when nothing changes (after about log of the longest path). Rounds are
    written to the shared folder, so a lost executor costs a round at most. Smallest neighbours are
    aggregated before they meet the edges, and they are written first, so that adaptive execution
    can split the join at a hub.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = staged(e, "edges")
    before = None
    for _ in range(rounds):
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == before or mark[0] == 0:
            break
        before = tuple(mark)
        near = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = staged(near.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "least")
        large = near.filter("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "large")
        least2 = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least2, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = staged(small.unionByName(least2.select("u", F.col("m").alias("v"))).distinct(), "edges")
        for old in (e, least, large, least2):
            drop_staged(old)
        e = small
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
