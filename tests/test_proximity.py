"""Single links within a distance against comparing all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import proximity


def brute(rows, within):
    group = {n: n for n, _, _ in rows}

    def top(n):
        while group[n] != n:
            n = group[n]
        return n

    for n, k, p in rows:
        for m, j, q in rows:
            if n < m and k == j and math.dist(p, q) <= within:
                a, b = sorted((top(n), top(m)))
                group[b] = a
    return {n: top(n) for n in group}


@pytest.mark.parametrize("dims", [2, 3])
def test_clusters_are_those_of_all_pairs(spark, dims):
    r = random.Random(dims)
    rows = []
    for k in ("a", "b", None):
        centres = [[r.uniform(-30, 30) for _ in range(dims)] for _ in range(14)]
        rows += [(k, [x + r.gauss(0, 1.2) for x in r.choice(centres)]) for _ in range(150)]
    rows += [("line", [0.99 * i] + [0.0] * (dims - 1)) for i in range(60)] + [("grid", [1.0 * i, 5.0] + [0.0] * (dims - 2)) for i in range(20)] + [("same", [3.0] * dims)] * 30
    rows = [(n, k, p) for n, (k, p) in enumerate(rows)]
    names = ["x", "y", "z"][:dims]
    df = spark.createDataFrame([(n, k, *p) for n, k, p in rows] + [(9999, "a", None, *[1.0] * (dims - 1))], "id long, k string, " + ", ".join(f"{c} double" for c in names)).withColumn("c0", F.lit("clash"))
    got = {x.node: x.cluster for x in proximity.near_groups(df, ["k"], "id", names, 1.0).collect()}
    assert got == brute(rows, 1.0) and len({c for n, c in got.items() if rows[n][1] == "line"}) == 1


def test_dense_cells_are_merged(spark):
    df = spark.range(40000).select(F.col("id"), (F.col("id") % 4 * 0.9 + F.rand(1) * 0.2).alias("x"), F.rand(2).alias("y"))
    x = proximity.merged(df, [], "id", ["x", "y"], 1.0).collect()
    assert len(x) == 1 and x[0].n == 40000 and x[0].cluster == 0
    assert proximity.near_groups(df.limit(0), [], "id", ["x", "y"], 1.0).count() == 0
    with pytest.raises(ValueError):
        proximity.near_groups(df, [], "id", ["x"], 1.0)
