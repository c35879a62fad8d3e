"""Points merged by single links within a distance, without comparing all pairs.

Space is cut into cells so small that points of one cell are always linked; they hang on the cell's first point. Only neighbouring cells can hold a link besides, and two cells
need one. Whether they have it is decided on ever smaller cells: two small cells whose furthest corners are near enough hold a link, two whose nearest corners are too far
hold none, and only points of small cells in between are measured. However many points a cell holds, it has few small cells.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators import graph

LEVELS = 3


def _gap(a: str, b: str, dims: int, more: int) -> Column:
    """The squared distance between cells in cell sides: of their nearest corners for more = -1, of their furthest for 1."""
    return sum((F.pow(F.greatest(F.abs(F.col(a)[i] - F.col(b)[i]) + more, F.lit(0)), F.lit(2)) for i in range(dims)), F.lit(0.0))


def near_groups(df: DataFrame, keys: list[str], node: str, point: list[str], within: float) -> DataFrame:
    """node, cluster: the smallest node that links lead to, for all nodes; two nodes of a key link where their points are at most within apart.

    point names two or three coordinates. Nodes are unique, rows that lack a node or coordinate don't count, and null keys are one key. Clusters of any length or
    number of points are whole. Points that are measured are those of cells an eighth of a cell wide whose corners leave the answer open.
    """
    if within <= 0 or len(point) not in (2, 3):
        raise ValueError("within must be above 0 and points have two or three coordinates")
    graph.checkpoints(df.sparkSession)
    dims = len(point)
    side = within / math.sqrt(dims) * (1 - 1e-9)
    limit = (within / side) ** 2
    key = F.xxhash64(*(F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys)) if keys else F.lit(0)
    at = lambda level: F.array(*(F.floor(F.col(p).cast("double") / (side / 2**level)) for p in point))
    told = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [node, *point]))
    pts = told.select(F.struct(*keys, key.alias("_h")).alias("k"), F.col(node).alias("node"), F.array(*(F.col(p).cast("double") for p in point)).alias("p"), *(at(level).alias(f"c{level}") for level in range(LEVELS + 1))).checkpoint()
    cells = pts.groupBy("k", "c0").agg(F.min("node").alias("head"))
    stars = pts.join(cells, ["k", "c0"]).select(F.col("head").alias("u"), F.col("node").alias("v")).checkpoint()
    steps = [o for o in itertools.product(range(-2, 3), repeat=dims) if o > (0,) * dims and sum(max(abs(x) - 1, 0) ** 2 for x in o) <= limit]
    offsets = F.array(*(F.array(*(F.lit(x).cast("long") for x in o)) for o in steps))
    to = cells.select("k", F.col("c0").alias("a"), F.col("head").alias("u"), F.explode(offsets).alias("o")).withColumn("b", F.zip_with("a", "o", lambda x, y: x + y))
    pairs = to.join(cells.select("k", F.col("c0").alias("b"), F.col("head").alias("v")), ["k", "b"]).select("k", "a", "b", "u", "v")
    open_pairs = pairs.select("k", "a", "b", "u", "v", F.col("a").alias("sa"), F.col("b").alias("sb")).checkpoint()
    linked = []
    for level in range(1, LEVELS + 1):
        small = pts.select("k", F.col(f"c{level - 1}").alias("big"), F.col(f"c{level}").alias("small")).distinct()
        x = open_pairs
        for s in ("sa", "sb"):
            x = x.join(small.select("k", F.col("big").alias(s), F.col("small").alias(f"n{s}")), ["k", s])
        x = x.select("k", "a", "b", "u", "v", F.col("nsa").alias("sa"), F.col("nsb").alias("sb"))
        x = x.filter(_gap("sa", "sb", dims, -1) <= limit * 4**level).withColumn("sure", _gap("sa", "sb", dims, 1) <= limit * 4**level).checkpoint()
        sure = x.filter("sure").select("k", "a", "b", "u", "v").distinct().checkpoint()
        linked.append(sure.select("u", "v"))
        open_pairs = x.drop("sure").join(sure.select("k", "a", "b"), ["k", "a", "b"], "left_anti").checkpoint()
    x = open_pairs
    for s in "ab":
        x = x.join(pts.select("k", F.col(f"c{LEVELS}").alias(f"s{s}"), F.col("p").alias(f"p{s}")), ["k", f"s{s}"])
    apart = sum((F.pow(F.col("pa")[i] - F.col("pb")[i], F.lit(2)) for i in range(dims)), F.lit(0.0))
    linked.append(x.filter(apart <= within * within).select("u", "v").distinct().checkpoint())
    edges = stars.select(F.col("u").alias("one"), F.col("v").alias("other"))
    for part in linked:
        edges = edges.unionByName(part.select(F.col("u").alias("one"), F.col("v").alias("other")))
    return graph.clusters(edges.checkpoint(), "one", "other")


def merged(df: DataFrame, keys: list[str], node: str, point: list[str], within: float) -> DataFrame:
    """keys, cluster, n and the mean of each coordinate: points within the distance of each other, by any chain, as one."""
    groups = near_groups(df, keys, node, point, within).withColumnRenamed("node", node)
    return df.join(groups, node).groupBy(*keys, "cluster").agg(F.count("*").alias("n"), *(F.avg(p).alias(p) for p in point))
