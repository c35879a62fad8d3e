"""Clusters from edges by alternating stars; lineage is cut in the session's checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HUBS = 1000  # a node with more than one edge in so many is a hub, so there are few of them


def checkpoints(spark: SparkSession) -> None:
    """The folder that spark.checkpoint.dir names is used; without one, on more machines than this, there is nothing to write to."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir').removesuffix('/')}-checkpoints")


def _with_least(edges: DataFrame, n: int) -> DataFrame:
    """edges (u, v) with m, the smallest of u and its neighbours. The edges of hubs are joined in place, so that they never meet in one task."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    hubs = least.filter(F.col("n") > max(10 * HUBS, n // HUBS)).select("u", "m")
    if n <= 10 * HUBS or not hubs.take(1):
        return edges.join(least.select("u", "m"), "u")
    hubs = F.broadcast(hubs)  # n edges, so at most HUBS rows
    return edges.join(hubs, "u").unionByName(edges.join(hubs, "u", "left_anti").join(least.select("u", "m"), "u"))


def clusters(edges: DataFrame, a: str, b: str, rounds: int = 50) -> DataFrame:
    """(node, cluster): the smallest node that edges lead to, for every node on an edge.

    A round points a node's larger neighbours at the smallest one, then each node's smaller neighbours at their smallest;
    once the edges stand still every node points at its cluster. Edges that don't within so many rounds are an error.
    """
    checkpoints(edges.sparkSession)
    nodes = edges.select(F.col(a).alias("node")).unionByName(edges.select(F.col(b).alias("node"))).filter("node is not null").distinct()
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct().checkpoint()
    state = None
    for _ in range(rounds):
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * now[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u > v").distinct().checkpoint()
    else:
        raise RuntimeError(f"the clusters still move after {rounds} rounds")
    return nodes.join(e, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("cluster"))


def chains(df: DataFrame, keys: list[str], at: str, node: str, within: float) -> DataFrame:
    """(node, cluster) where nodes of a key whose values differ by less than within are linked: one sort, as each cluster is a run in the order of the values. Nodes without a link are left out."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys).orderBy(at, node)
    fresh = F.coalesce((F.col(at) - F.lag(at).over(w) >= within).cast("int"), F.lit(1))
    x = df.filter(F.col(at).isNotNull()).select(*keys, F.col(node).alias("node"), at, fresh.alias("_fresh")).withColumn("_run", F.sum("_fresh").over(w.orderBy(at, "node").rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(*keys, "_run")
    return x.withColumn("cluster", F.min("node").over(own)).withColumn("_n", F.count("*").over(own)).filter("_n > 1").select("node", "cluster")
