"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.native import shared_checkpoints

HUB_SHARE = 1000  # a node with more than one edge in so many is a hub, so there are at most 2 * HUB_SHARE hubs
HUB_EDGES = 10_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _with_least(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """edges with m of their u. Edges of hubs are joined in place with the hubs' few rows, so that a hub's edges never meet in one task."""
    bound = max(HUB_EDGES, 2 * n // HUB_SHARE)
    hubs = least.filter(F.col("n") > bound).select("u", "m")
    if n <= bound or not hubs.take(1):
        return edges.join(least.select("u", "m"), "u")
    hubs = F.broadcast(hubs)  # the edges, counted both ways, are 2n, so at most HUB_SHARE rows
    return edges.join(hubs, "u").unionByName(edges.join(hubs, "u", "left_anti").join(least.select("u", "m"), "u"))


def components(edges: DataFrame, rounds: int = 60, files: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, for every node on an edge. edges has u, v (longs), any order, repeats and loops allowed.

    Rounds end when the edge set stands still, as it does once every node points at its component.
    An edge set that still moves after so many rounds is an error. Edges between rounds go to at most so many files.
    """
    shared_checkpoints(edges.sparkSession)

    def settled(x: DataFrame) -> DataFrame:
        x = x.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
        return (x.coalesce(files) if files else x).checkpoint()

    e = settled(edges)
    before = _state(e)
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_least(both, least, before[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = settled(small)
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"the components of {before[0]} edges still move after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
