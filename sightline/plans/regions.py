"""Regions over the driver tables: an embedding's values are pixels, discs and boxes that a few fixed cameras see."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.catalog import query
from sightline.operators import proximity, regions
from sightline.plans.tables import load

_E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def _vectors(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("e"))


_PIXELS = f"{_E}, px AS (SELECT vec_id, i // 8 AS y, i % 8 AS x FROM e, range(64) AS r(i) WHERE e[i + 1] > 0.02)"


@query("mask_components", f"""WITH RECURSIVE {_PIXELS},
near AS (SELECT a.vec_id, a.y * 8 + a.x AS p, b.y * 8 + b.x AS q FROM px a JOIN px b ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
reach AS (SELECT vec_id, p AS root, p FROM near UNION SELECT r.vec_id, r.root, n.q FROM reach r JOIN near n ON r.vec_id = n.vec_id AND r.p = n.p),
own AS (SELECT vec_id, p, min(root) AS root FROM reach GROUP BY 1, 2), parts AS (SELECT vec_id, root, count(*) AS area FROM own GROUP BY 1, 2),
kept AS (SELECT vec_id, root, area, area >= 0.2 * max(area) OVER (PARTITION BY vec_id) AS keep FROM parts)
SELECT e.vec_id, count(k.root) AS components, CAST(coalesce(sum(area) FILTER (WHERE NOT keep), 0) AS BIGINT) AS dropped,
coalesce((SELECT string_agg(CAST(o.p AS VARCHAR), ',' ORDER BY o.p) FROM own o JOIN kept j ON o.vec_id = j.vec_id AND o.root = j.root WHERE o.vec_id = e.vec_id AND j.keep), '') AS kept
FROM e LEFT JOIN kept k ON e.vec_id = k.vec_id GROUP BY e.vec_id""")
def mask_components(spark, sf_dir):
    """Masks of 8 by 8 pixels without the parts under a fifth of the largest one."""
    x = _vectors(spark, sf_dir)
    pixels = F.filter(F.transform("e", lambda v, i: F.when(v > 0.02, i.cast("long"))), lambda p: p.isNotNull() & (p < 64))
    x = regions.kept_components(x.select("vec_id", regions.runs_of(pixels, 8).alias("runs")), "runs", 0.2)
    return x.select("vec_id", "components", "dropped", F.array_join(regions.pixels_of(F.col("kept"), 8), ",").alias("kept"))


#: Three cameras about a cube of 32 cells a side, each with a disc as its mask.
_CAMERAS = ((40.0, 0, 32, 256, 0, 40, 32, 256, 0, 0, 1, 8), (32, 0, 40.0, 256, 32, 40, 0, 256, 1, 0, 0, 8), (40, 32, 0, 256, 0, 32, 40, 256, 0, 1, 0, 8))


def _disc(e, k: int):
    """Middle and radius of a mask, in pixels."""
    return 32 + 6 * e[3 * k], 32 + 6 * e[3 * k + 1], 9 + 2 * e[3 * k + 2]


def _disc_sql(k: int) -> str:
    a, b, c = (f"e[{3 * k + i}]" for i in (1, 2, 3))
    return f"32 + 6 * {a} AS cx, 32 + 6 * {b} AS cy, 9 + 2 * {c} AS r"


_VIEW = " UNION ALL ".join(f"SELECT vec_id, {_disc_sql(k)}, {', '.join(f'CAST({v} AS DOUBLE) AS c{i}' for i, v in enumerate(c))} FROM e" for k, c in enumerate(_CAMERAS))
_ROW = [f"c{4 * i} * (-4 + 0.25 * (x + 0.5)) + c{4 * i + 1} * (-4 + 0.25 * (y + 0.5)) + c{4 * i + 2} * (-4 + 0.25 * (z + 0.5)) + c{4 * i + 3}" for i in range(3)]


@query("visual_hull", f"""WITH {_E}, v AS ({_VIEW}), g AS (SELECT a.i AS x, b.i AS y, c.i AS z FROM range(32) a(i), range(32) b(i), range(32) c(i)),
s AS (SELECT vec_id, x, y, z, cx, cy, r, floor(({_ROW[0]}) / ({_ROW[2]})) AS u, floor(({_ROW[1]}) / ({_ROW[2]})) AS t FROM v, g),
h AS (SELECT vec_id, x, y, z FROM s WHERE (u - cx) * (u - cx) + (t - cy) * (t - cy) <= r * r AND u BETWEEN 0 AND 63 AND t BETWEEN 0 AND 63 GROUP BY ALL HAVING count(*) = 3)
SELECT vec_id, count(*) AS cells, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy, CAST(sum(z) AS BIGINT) AS sz FROM h GROUP BY 1""")
def visual_hull(spark, sf_dir):
    """How many cells, and where, three discs carve out of a cube."""
    x = _vectors(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    cx, cy, r = (F.element_at(F.array(*(_disc(F.col("e"), k)[i] for k in range(3))), F.col("k") + 1) for i in range(3))
    camera = F.element_at(F.array(*(F.array(*(F.lit(float(v)) for v in c)) for c in _CAMERAS)), F.col("k") + 1)
    x = x.select("vec_id", camera.alias("camera"), cx.alias("cx"), cy.alias("cy"), r.alias("r"))
    inside = lambda p: F.pow(p % 64 - F.col("cx"), F.lit(2.0)) + F.pow(F.floor(p / 64) - F.col("cy"), F.lit(2.0)) <= F.col("r") * F.col("r")
    x = x.select("vec_id", "camera", F.lit(64).alias("width"), F.lit(64).alias("height"), F.filter(F.sequence(F.lit(0), F.lit(4095)).cast("array<long>"), inside).alias("pixels"))
    found = regions.hulls(x, ["vec_id"], (-4.0, -4.0, -4.0), 0.25, 5)
    return found.groupBy("vec_id").agg(F.count("*").alias("cells"), *(F.sum(c).alias("s" + c) for c in "xyz"))


#: Cameras above a bench, as 3x4 matrices.
_ABOVE = ((100.0, 0, 32, 320, 0, 100, 24, 240, 0, 0, 0.1, 10), (80.0, 10, 32, 300, -10, 80, 24, 250, 0.02, 0, 0.1, 10), (90.0, -10, 30, 310, 10, 95, 20, 230, 0, 0.02, 0.1, 10))


def _corner(c, i: int, e, way: float):
    """A row of a camera times a corner of a thing on the bench."""
    return c[4 * i] * (2 * e[0] + way) + c[4 * i + 1] * (2 * e[1] + way) + c[4 * i + 3]


def _boxes(spark, sf_dir):
    x = _vectors(spark, sf_dir)
    box = lambda c: F.array(*(_corner(c, i, F.col("e"), way) / _corner(c, 2, F.col("e"), way) for way in (-3.0, 3.0) for i in (0, 1)))
    views = F.array(*(F.struct(F.lit(k).alias("view"), box(c).alias("box")) for k, c in enumerate(_ABOVE)))
    return x.select("label", F.inline(views))


_MATRIX = " UNION ALL ".join(f"SELECT {k} AS view, {', '.join(f'CAST({v} AS DOUBLE) AS c{i}' for i, v in enumerate(c))}" for k, c in enumerate(_ABOVE))
_CORNER = lambda i, way: f"(c{4 * i} * (2 * e[1] + {way}) + c{4 * i + 1} * (2 * e[2] + {way}) + c{4 * i + 3})"
_STABLE = f"""{_E}, c AS ({_MATRIX}), b AS (SELECT label, view, {', '.join(f"{_CORNER(i, w)} / {_CORNER(2, w)} AS b{2 * n + i}" for n, w in enumerate((-3.0, 3.0)) for i in (0, 1))} FROM e, c),
m AS (SELECT label, view, {', '.join(f'quantile_cont(b{i}, 0.5) AS b{i}' for i in range(4))}, quantile_cont((b0 + b2) / 2, 0.75) - quantile_cont((b0 + b2) / 2, 0.25) AS i0,
quantile_cont((b1 + b3) / 2, 0.75) - quantile_cont((b1 + b3) / 2, 0.25) AS i1, count(*) AS n FROM b GROUP BY 1, 2), stable AS (SELECT * FROM m WHERE n >= 10 AND i0 < 0.5 * (b2 - b0) AND i1 < 0.5 * (b3 - b1))"""


@query("stable_boxes", f"WITH {_STABLE} SELECT label, view, {', '.join(f'round(b{i}, 6) AS b{i}' for i in range(4))} FROM stable")
def stable_boxes(spark, sf_dir):
    x = regions.stable_boxes(_boxes(spark, sf_dir), ["label"], "view", "box")
    return x.select("label", "view", *(F.round(F.col("box")[i], 6).alias(f"b{i}") for i in range(4)))


@query("bench_footprints", f"""WITH {_STABLE}, g AS (SELECT a.i AS x, b.i AS y, -10 + (a.i + 0.5) * 0.25 AS gx, -10 + (b.i + 0.5) * 0.25 AS gy FROM range(80) a(i), range(80) b(i)),
s AS (SELECT label, x, y, gx, gy FROM stable JOIN c USING (view), g WHERE (c0 * gx + c1 * gy + c3) / (c8 * gx + c9 * gy + c11) BETWEEN b0 AND b2 AND (c4 * gx + c5 * gy + c7) / (c8 * gx + c9 * gy + c11) BETWEEN b1 AND b3),
h AS (SELECT label, x, y, gx, gy FROM s GROUP BY ALL HAVING count(*) = 3)
SELECT label, count(*) AS cells, round(-10 + 0.25 * min(x), 6) AS x1, round(-10 + 0.25 * min(y), 6) AS y1, round(-10 + 0.25 * (max(x) + 1), 6) AS x2, round(-10 + 0.25 * (max(y) + 1), 6) AS y2, round(avg(gx), 6) AS cx, round(avg(gy), 6) AS cy FROM h GROUP BY 1""")
def bench_footprints(spark, sf_dir):
    """By label, the cells of the bench that the steady boxes of all three views hold. Boxes cut out convex pieces, so they are one component."""
    x = regions.stable_boxes(_boxes(spark, sf_dir), ["label"], "view", "box")
    camera = F.element_at(F.array(*(F.array(*(F.lit(float(v)) for v in c)) for c in _ABOVE)), F.col("view") + 1)
    x = regions.footprints(x.withColumn("camera", camera), ["label"], 10.0, 0.25)
    return x.select("label", "cells", *(F.round(F.col("bounds")[i], 6).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))), *(F.round(F.col("centre")[i], 6).alias(c) for i, c in enumerate(("cx", "cy"))))


@query("merged_points", f"""WITH RECURSIVE {_E}, p AS (SELECT label, vec_id, 8 * e[1] AS x, 8 * e[2] AS y FROM e), n AS (SELECT a.vec_id AS u, b.vec_id AS v FROM p a JOIN p b ON a.label = b.label AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.16),
r(node, reach) AS (SELECT u, u FROM n UNION SELECT r.node, n.v FROM r JOIN n ON n.u = r.reach), c AS (SELECT node, min(reach) AS cluster FROM r GROUP BY 1)
SELECT label, cluster, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM c JOIN p ON node = vec_id GROUP BY 1, 2""")
def merged_points(spark, sf_dir):
    """Points of one label merged by chains of steps of at most 0.4."""
    x = _vectors(spark, sf_dir).select("label", "vec_id", (F.get("e", F.lit(0)) * 8).alias("x"), (F.get("e", F.lit(1)) * 8).alias("y"))
    found = proximity.merged(x, ["label"], "vec_id", ["x", "y"], 0.4)
    return found.select("label", "cluster", "n", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
