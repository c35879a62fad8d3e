"""Cameras, axes of pixel clouds, votes and prompts over the driver tables: an embedding's values stand for turns, points and pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.catalog import query
from sightline.functions import cameras as C
from sightline.functions import shapes as S
from sightline.operators import poses
from sightline.plans.tables import events, load, E

#: One lens for all views.
LENS = (600.0, 620.0, 320.0, 240.0)
BEND = (-0.1, 0.02, 0.001, -0.0005, 0.003)
SHIFTS = ((0.0, 0.0, 5.0), (0.3, -0.1, 5.0))


def _lit(values):
    return F.array(*(F.lit(float(v)) for v in values))


def _views(spark, sf_dir):
    """Two cameras, two points and two pixels of the first camera for each embedding."""
    x = load(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    turns = {n: C.turn_of(S.unit(F.slice("e", at, 4))) for n, at in (("a", 1), ("b", 9))}
    points = {n: S.scaled(F.slice("e", at, 3), F.lit(4.0)) for n, at in (("p", 5), ("q", 13))}
    x = x.select("vec_id", "label", "e", *(v.alias(n) for n, v in {**turns, **points}.items()))
    a, b = (C.Camera(_lit(LENS), _lit(BEND), F.col(n), _lit(s)) for n, s in zip("ab", SHIFTS))
    return x, a, b


def _turn(q: str) -> str:
    w, x, y, z = (f"{q}[{i}]" for i in range(1, 5))
    return f"""[1 - 2 * ({y} * {y} + {z} * {z}), 2 * ({x} * {y} - {w} * {z}), 2 * ({x} * {z} + {w} * {y}), 2 * ({x} * {y} + {w} * {z}), 1 - 2 * ({x} * {x} + {z} * {z}), 2 * ({y} * {z} - {w} * {x}),
2 * ({x} * {z} - {w} * {y}), 2 * ({y} * {z} + {w} * {x}), 1 - 2 * ({x} * {x} + {y} * {y})]"""


def _four(at: int) -> str:
    length = " + ".join(f"e[{at + i}] * e[{at + i}]" for i in range(4))
    return "[" + ", ".join(f"e[{at + i}] / sqrt({length})" for i in range(4)) + "]"


def _times(m: str, p: str, shift=(0, 0, 0)) -> str:
    return "[" + ", ".join(f"{m}[{3 * i + 1}] * {p}[1] + {m}[{3 * i + 2}] * {p}[2] + {m}[{3 * i + 3}] * {p}[3] + {shift[i]!r}" for i in range(3)) + "]"


def _back(m: str, p: str) -> str:
    return "[" + ", ".join(f"{m}[{i}] * {p}[1] + {m}[{3 + i}] * {p}[2] + {m}[{6 + i}] * {p}[3]" for i in (1, 2, 3)) + "]"


def _cross(a: str, b: str) -> str:
    return "[" + ", ".join(f"{a}[{j}] * {b}[{k}] - {a}[{k}] * {b}[{j}]" for j, k in ((2, 3), (3, 1), (1, 2))) + "]"


def _bend(x: str, y: str) -> tuple[str, str, str]:
    k1, k2, p1, p2, k3 = BEND
    r = f"({x} * {x} + {y} * {y})"
    return f"(1 + {k1} * {r} + {k2} * {r} * {r} + {k3} * {r} * {r} * {r})", f"(2 * {p1} * {x} * {y} + {p2} * ({r} + 2 * {x} * {x}))", f"({p1} * ({r} + 2 * {y} * {y}) + 2 * {p2} * {x} * {y})"


def _pixel(x: str) -> str:
    far, dx, dy = _bend(f"({x}[1] / {x}[3])", f"({x}[2] / {x}[3])")
    return f"[{LENS[0]} * ({x}[1] / {x}[3] * {far} + {dx}) + {LENS[2]}, {LENS[1]} * ({x}[2] / {x}[3] * {far} + {dy}) + {LENS[3]}]"


def _rounds(name: str, source: str, pixel: str) -> str:
    """Common tables that end in one called name, with x and y of the pixel at depth 1."""
    far, dx, dy = _bend("x", "y")
    out = [f"{name}0 AS (SELECT *, ({pixel}[1] - {LENS[2]}) / {LENS[0]} AS x0, ({pixel}[2] - {LENS[3]}) / {LENS[1]} AS y0, x0 AS x, y0 AS y FROM {source})"]
    out += [f"{name if k == 5 else name + str(k)} AS (SELECT * REPLACE ((x0 - {dx}) / {far} AS x, (y0 - {dy}) / {far} AS y) FROM {name}{k - 1})" for k in range(1, 6)]
    return ", ".join(out)


def _length(a: str) -> str:
    return f"sqrt({a}[1] * {a}[1] + {a}[2] * {a}[2] + {a}[3] * {a}[3])"


_SEEN = f"""v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), qs AS (SELECT *, {_four(1)} AS qa, {_four(9)} AS qb, [4 * e[5], 4 * e[6], 4 * e[7]] AS p, [4 * e[13], 4 * e[14], 4 * e[15]] AS q FROM v),
ts AS (SELECT *, {_turn('qa')} AS a, {_turn('qb')} AS b FROM qs), xs AS (SELECT *, {_times('a', 'p', SHIFTS[0])} AS pa, {_times('a', 'q', SHIFTS[0])} AS qa_, {_times('b', 'p', SHIFTS[1])} AS pb FROM ts),
seen AS (SELECT vec_id, label, e, qa, qb, a, b, p, q, pa, {_pixel('pa')} AS u, {_pixel('qa_')} AS w, {_pixel('pb')} AS t FROM xs)"""


@query("camera_projection", f"WITH {_SEEN} SELECT vec_id, round(u[1], 6) AS u, round(u[2], 6) AS v, round(pa[3], 6) AS depth, round(2 * degrees(acos(least(1.0, abs(qa[1] * qb[1] + qa[2] * qb[2] + qa[3] * qb[3] + qa[4] * qb[4])))), 5) AS turn, round(30 + 0.2 * 610 / pa[3], 6) AS gate FROM seen")
def camera_projection(spark, sf_dir):
    """The bent pixel of a point, its depth, the turn between two cameras, and a gate that grows with uncertainty."""
    x, a, b = _views(spark, sf_dir)
    pixel = C.project(a, F.col("p"))
    return x.select("vec_id", pixel.alias("u"), C.seen_from(a, F.col("p"))[2].alias("depth"), C.turn_between(a.turn, b.turn).alias("turn"), C.gate(30.0, F.lit(0.2), a, F.col("p")).alias("gate")).select(
        "vec_id", F.round(F.col("u")[0], 6).alias("u"), F.round(F.col("u")[1], 6).alias("v"), F.round("depth", 6).alias("depth"), F.round("turn", 5).alias("turn"), F.round("gate", 6).alias("gate")
    )


@query("pixel_rays", f"WITH {_SEEN}, {_rounds('s', 'seen', 'u')}, d AS (SELECT vec_id, x, y, {_back('a', '[x, y, 1]')} AS d FROM s) SELECT vec_id, round(x, 6) AS x, round(y, 6) AS y, round(d[1] / {_length('d')}, 6) AS dx, round(d[2] / {_length('d')}, 6) AS dy, round(d[3] / {_length('d')}, 6) AS dz FROM d")
def pixel_rays(spark, sf_dir):
    x, a, _ = _views(spark, sf_dir)
    x = x.withColumn("u", C.project(a, F.col("p")))
    x = x.select("vec_id", C.straightened(a, F.col("u")).alias("s"), C.ray(a, F.col("u")).alias("d"))
    return x.select("vec_id", *(F.round(F.col("s")[i], 6).alias(c) for i, c in enumerate("xy")), *(F.round(F.col("d")[i], 6).alias("d" + c) for i, c in enumerate("xyz")))


@query("epipolar_gaps", f"""WITH {_SEEN}, {_rounds('s', 'seen', 'u')}, d AS (SELECT * EXCLUDE (x, y, x0, y0), {_back('a', '[x, y, 1]')} AS d, {_back('a', str(list(SHIFTS[0])))} AS c FROM s),
f AS (SELECT *, {_times('b', '[-c[1], -c[2], -c[3]]', SHIFTS[1])} AS c2, {_times('b', 'd')} AS d2, [t[1] + 3, t[2]] AS t3 FROM d), g AS (SELECT *, {_cross('c2', 'd2')} AS n FROM f), {_rounds('h', 'g', 't3')}
SELECT vec_id, round(abs(n[1] * x + n[2] * y + n[3]) / sqrt(pow(n[1] / {LENS[0]}, 2) + pow(n[2] / {LENS[1]}, 2)), 4) AS gap FROM h""")
def epipolar_gaps(spark, sf_dir):
    """How far a pixel, moved by three, lies from the line of the same point in another view."""
    x, a, b = _views(spark, sf_dir)
    x = x.withColumn("u", C.project(a, F.col("p"))).withColumn("t", C.project(b, F.col("p"))).withColumn("t", F.array(F.col("t")[0] + 3, F.col("t")[1]))
    return x.select("vec_id", F.round(C.epipolar_gap(a.centre, C.ray(a, F.col("u")), b, F.col("t")), 4).alias("gap"))


@query("axis_planes", f"""WITH {_SEEN}, {_rounds('s', 'seen', 'u')}, d AS (SELECT * EXCLUDE (x, y, x0, y0), {_back('a', '[x, y, 1]')} AS d, {_back('a', str(list(SHIFTS[0])))} AS c FROM s), {_rounds('h', 'd', 'w')},
f AS (SELECT vec_id, c, {_cross('d', _back('a', '[x, y, 1]'))} AS n FROM h)
SELECT vec_id, round(n[1] / {_length('n')}, 5) AS nx, round(n[2] / {_length('n')}, 5) AS ny, round(n[3] / {_length('n')}, 5) AS nz, round(-(n[1] * c[1] + n[2] * c[2] + n[3] * c[3]) / {_length('n')}, 5) AS plane FROM f""")
def axis_planes(spark, sf_dir):
    """The plane that a segment of one view spans with its camera."""
    x, a, _ = _views(spark, sf_dir)
    x = x.withColumn("u", C.project(a, F.col("p"))).withColumn("w", C.project(a, F.col("q"))).select("vec_id", C.plane_of_axis(a, F.col("u"), F.col("w")).alias("m"))
    return x.select("vec_id", *(F.round(F.col("m.normal")[i], 5).alias("n" + c) for i, c in enumerate("xyz")), F.round("m.offset", 5).alias("plane"))


@query("similarity_fits")
def similarity_fits(spark, sf_dir):
    """By label, the similarity that leads from the first camera's axes to the second's."""
    x, a, b = _views(spark, sf_dir)
    x = x.select("label", C.seen_from(a, F.col("p")).alias("s"), C.seen_from(b, F.col("p")).alias("t"))
    fit = poses.similarity(x, ["label"], "s", "t")
    return fit.select("label", F.round("scale", 6).alias("scale"), F.transform("turn", lambda v: F.round(v, 6)).alias("turn"), F.transform("shift", lambda v: F.round(v, 6)).alias("shift"))


@query("lowest_planes")
def lowest_planes(spark, sf_dir):
    """By label, the plane through the lowest fifth of the points."""
    x, _, _ = _views(spark, sf_dir)
    found = poses.lowest_plane(x, ["label"], "p", F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)), share=0.2, below=0.1)
    return found.select("label", "points", "fitted", *(F.round(c, 6).alias(c) for c in ("offset", "degrees", "rms", "p95", "below")))


@query("views_left_out")
def views_left_out(spark, sf_dir):
    """Four straight views of each point, one pixel off in one of them: each against the point of the other three."""
    x = load(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    x = x.withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("p", S.scaled(F.slice("e", 5, 3), F.lit(4.0)))
    turn = C.turn_of(S.unit(F.array(F.lit(1.0), F.sin(F.col("view") * 1.0) / 4, F.cos(F.col("view") * 1.0) / 4, F.lit(0.0))))
    x = x.withColumn("turn", turn).withColumn("shift", F.array(F.col("view") * 0.2, F.col("view") * -0.1, F.lit(5.0)))
    camera = C.Camera(_lit((600, 600, 0, 0)), _lit([0] * 5), F.col("turn"), F.col("shift"))
    entry = lambda i, j: F.col("turn")[3 * i + j] if j < 3 else F.col("shift")[i]
    x = x.withColumn("camera", F.array(*(entry(i, j) * (600.0 if i < 2 else 1.0) for i in range(3) for j in range(4)))).withColumn("u", C.project(camera, F.col("p")))
    x = x.select("vec_id", "view", "camera", (F.col("u")[0] + F.when(F.col("view") == F.col("vec_id") % 4, 1.0).otherwise(0.0)).alias("u"), F.col("u")[1].alias("v"))
    return poses.left_out(x, ["vec_id"]).select("vec_id", "view", F.round("away", 4).alias("away"))


_CLOUD = "cloud AS (SELECT vec_id, 100.0 * e[2 * i + 1] AS x, 40.0 * e[2 * i + 2] AS y FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), range(32) AS r(i))"
_AXIS = f"""{_CLOUD}, m AS (SELECT vec_id, count(*) AS n, avg(x) AS cx, avg(y) AS cy, var_pop(x) AS a, var_pop(y) AS b, covar_pop(x, y) AS c FROM cloud GROUP BY 1),
ax AS (SELECT *, (a + b) / 2 AS h, sqrt(pow((a - b) / 2, 2) + c * c) AS r, cos(atan2(2 * c, a - b) / 2) AS dx, sin(atan2(2 * c, a - b) / 2) AS dy FROM m),
pos AS (SELECT vec_id, (x - cx) * dx + (y - cy) * dy AS s, (y - cy) * dx - (x - cx) * dy AS o FROM cloud JOIN ax USING (vec_id)), ends AS (SELECT vec_id, min(s) AS first, max(s) AS last FROM pos GROUP BY 1)"""
_WIDTHS = f"""{_AXIS}, wide AS (SELECT vec_id, CAST(least(floor((s - first) / 6), ceil((last - first) / 6) - 1) AS BIGINT) AS bin, max(o) - min(o) + 1 AS width FROM pos JOIN ends USING (vec_id) GROUP BY 1, 2 HAVING count(*) >= 2)"""


def _cloud(spark, sf_dir):
    x = load(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"), F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    return x.select("vec_id", (100.0 * F.get("e", 2 * F.col("i"))).alias("x"), (40.0 * F.get("e", 2 * F.col("i") + 1)).alias("y"))


@query("cloud_axes", f"WITH {_AXIS} SELECT vec_id, n, round(cx, 5) AS cx, round(cy, 5) AS cy, round(dx, 5) AS dx, round(dy, 5) AS dy, round(sqrt((h + r) / (h - r)), 5) AS elongation, round(sqrt(12 * (h - r)), 5) AS width, round(first, 5) AS first, round(last, 5) AS last FROM ax JOIN ends USING (vec_id)")
def cloud_axes(spark, sf_dir):
    x = poses.axes(_cloud(spark, sf_dir), ["vec_id"])
    return x.select("vec_id", "n", *(F.round(c, 5).alias(c) for c in ("cx", "cy", "dx", "dy", "elongation", "width", "first", "last")))


@query("axis_widths", f"WITH {_WIDTHS} SELECT vec_id, bin, round(width, 5) AS width FROM wide")
def axis_widths(spark, sf_dir):
    cloud = _cloud(spark, sf_dir)
    return poses.width_profiles(cloud, ["vec_id"], poses.axes(cloud, ["vec_id"]), 6.0).select("vec_id", "bin", F.round("width", 5).alias("width"))


@query("axis_tails", f"""WITH {_WIDTHS}, body AS (SELECT vec_id, quantile_cont(width, 0.75) AS body FROM wide GROUP BY 1),
k AS (SELECT vec_id, body, row_number() OVER (PARTITION BY vec_id ORDER BY bin) - 1 AS i, row_number() OVER (PARTITION BY vec_id ORDER BY bin DESC) - 1 AS j, width >= 0.6 * body AS t,
lead(width) OVER (PARTITION BY vec_id ORDER BY bin) >= 0.6 * body AS after, lag(width) OVER (PARTITION BY vec_id ORDER BY bin) >= 0.6 * body AS before FROM wide JOIN body USING (vec_id)),
runs AS (SELECT vec_id, body, coalesce(min(i) FILTER (t AND coalesce(after, true)), count(*)) * 6.0 AS tail0, coalesce(min(j) FILTER (t AND coalesce(before, true)), count(*)) * 6.0 AS tail1 FROM k GROUP BY 1, 2)
SELECT vec_id, round(body, 5) AS body, CAST(tail0 AS DOUBLE) AS tail0, CAST(tail1 AS DOUBLE) AS tail1, CASE WHEN greatest(tail0, tail1) > 0 AND abs(tail0 - tail1) > 0.3 * body AND greatest(tail0, tail1) >= 1.5 * least(tail0, tail1)
THEN CASE WHEN tail0 > tail1 THEN 0 ELSE 1 END END AS tip FROM runs""")
def axis_tails(spark, sf_dir):
    """Thin ends of a cloud along its axis, and the end that is the tip."""
    cloud = _cloud(spark, sf_dir)
    widths = poses.width_profiles(cloud, ["vec_id"], poses.axes(cloud, ["vec_id"]), 6.0)
    return poses.tails(widths, ["vec_id"], 6.0, 0.6, 0.3, 1.5).withColumn("body", F.round("body", 5))


@query("volume_and_cost", f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), l AS (SELECT vec_id, e, [e[4] / n, e[5] / n, e[6] / n] AS u, [e[10] / k, e[11] / k, e[12] / k] AS w, [e[7] - e[1], e[8] - e[2], e[9] - e[3]] AS m
FROM (SELECT *, sqrt(e[4] * e[4] + e[5] * e[5] + e[6] * e[6]) AS n, sqrt(e[10] * e[10] + e[11] * e[11] + e[12] * e[12]) AS k FROM v)),
d AS (SELECT *, u[1] * w[1] + u[2] * w[2] + u[3] * w[3] AS c, m[1] * u[1] + m[2] * u[2] + m[3] * u[3] AS mu, m[1] * w[1] + m[2] * w[2] + m[3] * w[3] AS mw, m[1] * m[1] + m[2] * m[2] + m[3] * m[3] AS mm FROM l)
SELECT vec_id, round(greatest(-0.1 - e[20], e[20] - 0.05, -0.2 - e[21], e[21] - 0.1, -0.05 - e[22], e[22] - 0.02), 6) AS beyond, round((sqrt(mm - mu * mu) + sqrt(mm - mw * mw)) / 2 + 2 * sqrt(1 - least(1.0, c * c)) + 0.5 * abs(mu), 5) AS cost FROM d""")
def volume_and_cost(spark, sf_dir):
    """How far a point lies outside a box, and the cost of taking two lines for one."""
    x = load(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    s = lambda i: F.slice("e", i, 3)
    return x.select("vec_id", F.round(C.beyond_volume(s(20), _lit((-0.1, -0.2, -0.05)), _lit((0.05, 0.1, 0.02))), 6).alias("beyond"), F.round(C.line_cost(s(1), S.unit(s(4)), s(7), S.unit(s(10)), 2.0), 5).alias("cost"))


@query("boxes_on_ends", """WITH b AS (SELECT l_orderkey, l_linenumber, 10.0 + l_linenumber AS len, l_quantity - 20 AS x0, l_quantity - 20 + 2 + l_suppkey % 5 AS x1, l_partkey % 9 - 4 AS y0, l_partkey % 9 - 1 AS y1 FROM lineitem),
s AS (SELECT *, (x0 + x1) / 2.0 AS mid, (y0 + y1) / 2.0 AS across, (x0 + x1) / 2.0 >= len / 2 AS last FROM b)
SELECT l_orderkey, l_linenumber, CASE WHEN last THEN 1 ELSE 0 END AS end_, abs(across) AS across, CASE WHEN last THEN mid - len ELSE -mid END AS beyond, CASE WHEN last THEN x0 - len ELSE -x1 END AS gap, 5 + CASE WHEN last THEN greatest(x1, len) ELSE least(x0, 0) END AS to_x
FROM s WHERE abs(across) <= 4 AND NOT (mid BETWEEN 4 AND len - 4) AND CASE WHEN last THEN x0 - len ELSE -x1 END <= 4""")
def boxes_on_ends(spark, sf_dir):
    """Boxes that sit on an end of a level axis."""
    q, five = F.col("l_quantity").cast("double"), F.lit(5.0)
    start, stop = F.array(five, F.lit(0.0)), F.array(15.0 + F.col("l_linenumber"), F.lit(0.0))
    y = (F.col("l_partkey") % 9).cast("double")
    box = F.array(q - 15, y - 4, q - 13 + F.col("l_suppkey") % 5, y - 1)
    x = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.box_on_end(start, stop, box, 4.0).alias("b")).where("b IS NOT NULL")
    return x.select("l_orderkey", "l_linenumber", F.col("b.end").alias("end_"), "b.across", "b.beyond", "b.gap", F.col("b.to")[0].alias("to_x"))


@query("taper_votes", """WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity AS w0, l_suppkey % 50 AS w1, l_partkey % 4 AS t, l_linenumber = 3 AS manifold, l_tax * 100 AS residual, l_orderkey % 5 AS way FROM lineitem),
v AS (SELECT *, least(greatest((greatest(w0, w1) / least(w0, w1) - 1.25) / 1.25, 0), 1) AS sure FROM s WHERE least(w0, w1) > 0 UNION ALL SELECT *, NULL FROM s WHERE NOT least(w0, w1) > 0),
e AS (SELECT *, CASE WHEN sure > 0 THEN CASE WHEN manifold = (w0 > w1) THEN 0 ELSE 1 END END AS bw, CASE WHEN NOT manifold AND t < 2 THEN t END AS bt FROM v)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN way = 1 THEN 1 - coalesce(bw, bt) ELSE coalesce(bw, bt) END AS INT) AS end_, round(CASE WHEN bw IS NULL THEN 0.6 WHEN bt IS NULL THEN sure ELSE greatest(sure, 0.6) END, 6) AS confidence
FROM e WHERE coalesce(bw, bt) IS NOT NULL AND way < 4 AND residual <= 6 AND coalesce(bw = bt, true)""")
def taper_votes(spark, sf_dir):
    """Which end of a line is the tip, by the widths and tails of one view."""
    t, way = F.col("l_partkey") % 4, F.col("l_orderkey") % 5
    vote = C.taper_vote(F.col("l_quantity").cast("double"), (F.col("l_suppkey") % 50).cast("double"), F.when(t < 2, t), F.col("l_linenumber") == 3, F.round(F.col("l_tax") * 100), F.when(way < 4, way == 1), 1.25, 2.5, F.lit(0.6), 6.0)
    x = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", vote.alias("v")).where("v IS NOT NULL")
    return x.select("l_orderkey", "l_linenumber", F.col("v.end").cast("int").alias("end_"), F.round("v.confidence", 6).alias("confidence"))


@query("track_confidence", """WITH s AS (SELECT l_orderkey, l_linenumber, ['observed', 'single_view', 'coasting', 'held', 'lost'][1 + l_suppkey % 5] AS state, l_quantity % 5 AS n, l_partkey % 40 AS r, l_partkey % 3 = 0 AS disputed, l_orderkey % 45 AS unseen FROM lineitem),
c AS (SELECT *, round(CASE WHEN state = 'lost' THEN 0 WHEN state IN ('coasting', 'held') THEN 0.5 * greatest(0, 1 - unseen / 30) ELSE least(n / 4, 1) * greatest(0, 1 - r / 32) * CASE WHEN disputed THEN 0.5 ELSE 1 END END, 3) AS confidence FROM s)
SELECT l_orderkey, l_linenumber, confidence, state <> 'observed' OR disputed OR confidence < 0.3 AS abstain FROM c""")
def track_confidence(spark, sf_dir):
    state = F.element_at(F.array(*(F.lit(s) for s in ("observed", "single_view", "coasting", "held", "lost"))), (1 + F.col("l_suppkey") % 5).cast("int"))
    p = F.col("l_partkey")
    c = C.confidence(state, F.col("l_quantity") % 5, F.lit(4), p % 40, p % 3 == 0, F.col("l_orderkey") % 45, ("coasting", "held"), 30, 32.0, 0.3)
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", c.alias("c")).select("l_orderkey", "l_linenumber", "c.*")


@query("slot_exclusivity", """WITH p AS (SELECT l_orderkey // 400 AS frame, l_partkey % 60 AS pixel, l_suppkey % 4 AS slot, max(l_quantity) - 20.0 AS logit, (l_orderkey // 400 + l_suppkey % 4) % 5 > 0 AS present FROM lineitem GROUP BY ALL),
c AS (SELECT *, present AND logit > 0 AS claim, count(*) FILTER (present AND logit > 0) OVER w AS claims, min(CASE WHEN present AND logit > 0 THEN {'l': -logit, 's': slot} END) OVER w AS best FROM p WINDOW w AS (PARTITION BY frame, pixel))
SELECT frame, slot, count(*) FILTER (claim) AS pixels, coalesce(round(avg(CASE WHEN claims > 1 THEN 1.0 ELSE 0 END) FILTER (claim), 6), 0) AS contested, round(sum(CASE WHEN claim AND claims > 1 AND slot <> best.s THEN least(logit, -8.0) ELSE logit END), 4) AS logits FROM c GROUP BY 1, 2""")
def slot_exclusivity(spark, sf_dir):
    """Pixels that several slots claim go to the largest logit."""
    frame, slot = F.floor(F.col("l_orderkey") / 400).alias("frame"), (F.col("l_suppkey") % 4).alias("slot")
    p = load(spark, sf_dir, "lineitem").groupBy(frame, (F.col("l_partkey") % 60).alias("pixel"), slot).agg((F.max("l_quantity") - 20.0).alias("logit"))
    x = poses.exclusive(p.withColumn("present", (F.col("frame") + F.col("slot")) % 5 > 0), ["frame"], -8.0)
    claim = F.col("present") & (F.col("logit") > 0)
    return x.groupBy("frame", "slot").agg(F.count_if(claim).alias("pixels"), F.coalesce(F.round(F.avg(F.when(claim, F.col("contested").cast("double"))), 6), F.lit(0.0)).alias("contested"), F.round(F.sum("resolved"), 4).alias("logits"))


@query("pooled_vectors", """WITH s AS (SELECT label, i, sum(v * (vec_id % 5)) AS s FROM (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2)
SELECT label, i - 1 AS place, round(s / sqrt(sum(s * s) OVER (PARTITION BY label)), 6) AS value FROM s""")
def pooled_vectors(spark, sf_dir):
    x = load(spark, sf_dir, "embeddings").withColumn("e", F.transform("embedding", lambda v: v.cast("double")))
    x = poses.pooled_vector(x, ["label"], "e", (F.col("vec_id") % 5).cast("double"), 64)
    return x.select("label", F.posexplode("pooled").alias("place", "value")).select("label", F.col("place").cast("long").alias("place"), F.round("value", 6).alias("value"))


@query("agreed_offsets", f"""WITH {E}, m AS (SELECT user_id, event_id % 3 AS metric, median(value / 4) AS m FROM e WHERE event_id % 7 > 0 GROUP BY 1, 2),
a AS (SELECT user_id, count(*) AS n, list(m ORDER BY m, metric) AS l, list(metric ORDER BY m, metric) AS k FROM m GROUP BY 1),
o AS (SELECT *, CASE WHEN n = 3 AND l[3] - l[1] > 6 THEN CASE WHEN l[2] - l[1] <= 6 AND l[3] - l[2] > 6 THEN 3 WHEN l[3] - l[2] <= 6 AND l[2] - l[1] > 6 THEN 1 END END AS out FROM a),
v AS (SELECT *, CASE WHEN l[-1] - l[1] <= 6 THEN l WHEN out = 3 THEN l[1:2] WHEN out = 1 THEN l[2:3] END AS vote FROM o), f AS (SELECT *, list_avg(vote) AS off, round_even(list_avg(vote), 0) AS chosen FROM v)
SELECT user_id, CAST(chosen AS BIGINT) AS chosen, round(off, 6) AS "offset", CASE WHEN chosen IS NOT NULL THEN CAST(greatest(CASE WHEN out IS NULL THEN 1 ELSE 3 END, ceil(greatest(abs(vote[1] - chosen), abs(vote[-1] - chosen)) - 1e-9)) AS BIGINT) END AS uncertainty, k[out] AS dropped FROM f""")
def agreed_offsets(spark, sf_dir):
    """Three measures of each user vote for one offset."""
    x = events(spark, sf_dir).select("user_id", (F.col("event_id") % 3).alias("metric"), F.when(F.col("event_id") % 7 > 0, F.col("value") / 4).alias("peak"))
    return poses.agreed_offset(x, ["user_id"], 6.0, 3).withColumn("offset", F.round("offset", 6))


@query("floors_left_out", """WITH c AS (SELECT l_orderkey, l_orderkey % 12 AS fold, max(l_discount * 10) FILTER (l_quantity > 10) AS score, arg_max(l_tax * 12, {'d': l_discount, 'n': l_linenumber, 't': l_tax}) FILTER (l_quantity > 10) AS quality FROM lineitem GROUP BY 1),
p AS (SELECT fold, f AS floor, count(*) AS cells, count(*) FILTER (score >= f) AS accepted, count(*) FILTER (score >= f AND quality < 0.3) AS harm, coalesce(sum(quality) FILTER (score >= f), 0) AS quality FROM c, (VALUES (0.0), (0.25), (0.45), (0.65)) AS t(f) GROUP BY 1, 2),
r AS (SELECT a.fold, a.floor, sum(b.cells) AS cells, sum(b.accepted) AS accepted, sum(b.harm) AS harm, sum(b.quality) AS quality FROM p a JOIN p b ON a.floor = b.floor AND a.fold <> b.fold GROUP BY 1, 2),
b AS (SELECT fold, coalesce(arg_max(floor, {'q': round(quality / accepted, 9), 'f': -floor}) FILTER (accepted > 0 AND accepted >= 0.25 * cells AND harm <= 0.4 * accepted), 0) AS floor FROM r GROUP BY 1)
SELECT fold, CAST(floor AS DOUBLE) AS floor, cells, accepted, harm, round(CASE WHEN accepted > 0 THEN quality / accepted END, 6) AS quality FROM b JOIN p USING (fold, floor)""")
def floors_left_out(spark, sf_dir):
    """For each fold of orders the score floor that does best on the others."""
    picked = F.col("l_quantity") > 10
    best = F.max_by(F.col("l_tax") * 12, F.when(picked, F.struct("l_discount", "l_linenumber", "l_tax")))
    cells = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.when(picked, F.col("l_discount") * 10)).alias("score"), best.alias("quality")).withColumn("fold", F.col("l_orderkey") % 12)
    return poses.floors_left_out(cells, [0.0, 0.25, 0.45, 0.65], 0.3, 0.4, 0.25).withColumn("quality", F.round("quality", 6))


@query("prompts", """SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN 'part' || p_size END AS target, CASE WHEN p_partkey % 4 < 3 THEN [p_size, -2, p_size + 5, 9] END AS box,
CASE WHEN p_partkey % 4 < 3 THEN CASE WHEN p_partkey % 4 = 1 THEN [[1, 2], [p_size, 4]] ELSE [] END END AS fg, CASE WHEN p_partkey % 4 < 3 THEN CASE WHEN p_partkey % 4 > 0 THEN [[7, p_size]] ELSE [] END END AS bg,
CASE p_partkey % 4 WHEN 0 THEN 'arm' WHEN 1 THEN 'run' || p_size WHEN 2 THEN 'other.v2' ELSE '' END AS name, CASE p_partkey % 4 WHEN 0 THEN '/a=b/x' WHEN 1 THEN '/r/run' || p_size || '/tracks.jsonl' WHEN 2 THEN './x=1/other.v2.jsonl' ELSE 'tracks.jsonl' END AS path FROM part""")
def prompts(spark, sf_dir):
    """Prompts and named paths read from text."""
    kind, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    head = F.concat(F.lit(" part"), n, F.lit("="), n, F.lit(",-2, "), (F.col("p_size") + 5).cast("string"), F.lit(",9"))
    marks = F.when(kind == 1, F.concat(F.lit(";fg=1,2;bg=7,"), n, F.lit(";fg="), n, F.lit(",4"))).when(kind == 2, F.concat(F.lit(";bg=7,"), n)).when(kind == 3, ";mid=1,2").otherwise("")
    item = F.when(kind == 0, F.lit(" arm = /a=b/x")).when(kind == 1, F.concat(F.lit("/r/run"), n, F.lit("/tracks.jsonl"))).when(kind == 2, "./x=1/other.v2.jsonl").otherwise("tracks.jsonl")
    x = load(spark, sf_dir, "part").select("p_partkey", C.prompt(F.concat(head, marks)).alias("a"), C.named_path(item).alias("b"))
    return x.select("p_partkey", "a.*", "b.*")
