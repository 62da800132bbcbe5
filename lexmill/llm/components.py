"""Connected components of a graph in DataFrames: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import checkpointed

#: A node with more than this part (one in) of the pairs is joined by broadcast.
HUB_SHARE = 1000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def _star(pairs: DataFrame, linked) -> DataFrame:
    """Links the neighbours v of each u that `linked` chooses, to the least of u and its neighbours in `pairs`.

    A hub is a node with more than a HUB_SHARE-th of the pairs. There are fewer than HUB_SHARE of them, whatever the size,
    so their least neighbours are broadcast and their pairs stay where they are; the other pairs meet by shuffle.
    """
    told = checkpointed(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m")))
    total = told.agg(F.sum("n")).first()[0] or 0
    hubs = F.broadcast(told.where(F.col("n") * HUB_SHARE > total).select("u", "m"))
    rest = pairs.join(hubs.select("u"), "u", "left_anti").join(told.select("u", "m"), "u")
    return pairs.join(hubs, "u").unionByName(rest).transform(linked)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its least node.

    Each round groups with partial minima and joins on the node, hubs by broadcast, so a hub costs neither a collected list
    nor a task of its own; rounds grow with the logarithm of the longest chain. Every round's edges go to the shared checkpoint folder.
    """
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(max_rounds):
        large = _star(_both_ways(now), lambda x: x.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        large = large.where("a <> b").distinct()
        pairs = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = _star(pairs, lambda x: x.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b")))
        now = checkpointed(small.where("a <> b").distinct())
        # settled when every edge leads to a node that has no smaller one, and each node has one edge
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = (seen["n"], seen["h"])
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
