"""Lines in several views over the driver tables: two points of an embedding are the ends of a thing that up to five cameras see."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.catalog import query
from sightline.functions import cameras as C
from sightline.functions import shapes as S
from sightline.operators import combos, lines
from sightline.plans.tables import load

_LENS, _BEND = (900.0, 880.0, 640.0, 360.0), (-0.05, 0.01, 0.0005, -0.0002, 0.0)


def _lit(values):
    return F.array(*(F.lit(float(v)) for v in values))


def _seen(spark, sf_dir, views: int = 5):
    """vec_id, label, view, camera, p, q: cameras on an arc about the thing."""
    x = load(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    x = x.withColumn("p", S.scaled(F.slice("e", 5, 3), F.lit(4.0))).withColumn("q", F.zip_with("p", S.scaled(S.unit(F.slice("e", 9, 3)), F.lit(12.0)), lambda a, b: a + b))
    x = x.withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(views - 1))))
    half = (F.col("view") - 2) * 0.3
    x = x.withColumn("turn", C.turn_of(F.array(F.cos(half), F.lit(0.0), F.sin(half), F.lit(0.0))))
    return x.withColumn("shift", _lit((0.0, 0.0, 60.0))), C.Camera(_lit(_LENS), _lit(_BEND), F.col("turn"), F.col("shift"))


def _rows(spark, sf_dir):
    """Ends as pixels, a pixel of noise by hash; every seventh thing has a view on something else, view 4 sees its middle alone."""
    x, camera = _seen(spark, sf_dir)
    noise = lambda n: F.pmod(F.xxhash64("vec_id", "view", F.lit(n)), F.lit(1000)) / 1000.0 - 0.5
    wrong = F.when((F.col("vec_id") % 7 == 0) & (F.col("view") == F.col("vec_id") % 4), 80.0).otherwise(0.0)
    pixel = lambda point, n: C.let(C.project(camera, point), lambda u: F.array(u[0] + noise(n) + wrong, u[1] + noise(n + 1) - wrong))
    middle = F.zip_with("p", "q", lambda a, b: (a + b) / 2)
    one, other = (F.when(F.col("view") < 4, pixel(F.col(c), n)) for c, n in (("p", 1), ("q", 3)))
    x = x.withColumn("one", one).withColumn("other", other).withColumn("middle", pixel(middle, 5))
    return x.select("vec_id", "view", F.lit(1.0).alias("weight"), *lines.observed(camera, F.col("one"), F.col("other"), F.col("middle")))


@query("lines_in_views")
def lines_in_views(spark, sf_dir):
    """For each thing the line that its views agree on, grown to its known length of 12, and the views that were dropped."""
    found = lines.line_fits(_rows(spark, sf_dir), ["vec_id"], lines.Rules(gate=6.0, angle=5.0, length=12.0))
    rounded = lambda c: F.transform(c, lambda v: F.round(v, 5))
    return found.select("vec_id", rounded("point").alias("point"), rounded("direction").alias("direction"), *(F.round(c, 5).alias(c) for c in ("low", "high", "condition", "worst")), "completed", "views", "dropped")


@query("lines_left_out")
def lines_left_out(spark, sf_dir):
    """Each view's axis against the line of the other views."""
    found = lines.lines_left_out(_rows(spark, sf_dir), ["vec_id"])
    return found.select("vec_id", "view", "fitted", *(F.round(c, 4).alias(c) for c in ("pixels", "degrees", "condition")))


def _v(name: str, parts) -> str:
    return ", ".join(f"{x} AS {name}{i}" for i, x in enumerate(parts))


def _dot(a: str, b: str) -> str:
    return "(" + " + ".join(f"{a}{i} * {b}{i}" for i in range(3)) + ")"


def _cross(a: str, b: str) -> list[str]:
    return [f"{a}{j} * {b}{k} - {a}{k} * {b}{j}" for j, k in ((1, 2), (2, 0), (0, 1))]


#: Two planes need no eigenvector: their line runs along the cross product of the normals, and its point nearest to the origin solves both.
_TWO = f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pq AS (SELECT vec_id, {", ".join(f"4 * e[{5 + i}] AS p{i}" for i in range(3))}, {", ".join(f"4 * e[{5 + i}] + 12 * e[{9 + i}] / sqrt(e[9] * e[9] + e[10] * e[10] + e[11] * e[11]) AS q{i}" for i in range(3))} FROM e),
c AS (SELECT *, 60 * sin(-1.2) AS a0, 0.0 AS a1, -60 * cos(-1.2) AS a2, 60 * sin(1.2) AS b0, 0.0 AS b1, -60 * cos(1.2) AS b2 FROM pq),
d AS (SELECT *, {_v("r", [f"p{i} - a{i}" for i in range(3)])}, {_v("s", [f"q{i} - a{i}" for i in range(3)])}, {_v("t", [f"p{i} - b{i}" for i in range(3)])}, {_v("u", [f"q{i} - b{i}" for i in range(3)])} FROM c),
n AS (SELECT vec_id, {_v("p", [f"p{i}" for i in range(3)])}, {_v("a", [f"a{i}" for i in range(3)])}, {_v("b", [f"b{i}" for i in range(3)])}, {_v("m", _cross("r", "s"))}, {_v("n", _cross("t", "u"))} FROM d),
w AS (SELECT *, {_v("l", _cross("m", "n"))}, degrees(acos(least(1.0, abs({_dot("m", "n")}) / sqrt({_dot("m", "m")} * {_dot("n", "n")})))) AS wide, {_dot("m", "a")} AS f, {_dot("n", "b")} AS g FROM n),
o AS (SELECT *, {_v("h", _cross("n", "l"))}, {_v("k", _cross("l", "m"))}, {_dot("l", "l")} AS z FROM w WHERE wide >= 5)
SELECT vec_id, {", ".join(f"round((f * h{i} + g * k{i}) / z, 3) AS {c}" for i, c in enumerate("xyz"))}, {", ".join(f"round(abs(l{i}) / sqrt(z), 4) AS {c}" for i, c in enumerate(("dx", "dy", "dz")))} FROM o"""


@query("line_of_two_views", _TWO)
def line_of_two_views(spark, sf_dir):
    """The line of the outer two views alone: its point nearest to the origin and the size of its direction's parts."""
    x, camera = _seen(spark, sf_dir)
    x = x.filter("view in (0, 4)").withColumn("one", C.project(camera, F.col("p"))).withColumn("other", C.project(camera, F.col("q")))
    x = x.select("vec_id", "view", F.lit(1.0).alias("weight"), *lines.observed(camera, F.col("one"), F.col("other"), F.col("one")))
    found = lines.line_fits(x, ["vec_id"], lines.Rules(gate=5.0, angle=5.0, gap=1e9))
    along = sum(F.col("point")[i] * F.col("direction")[i] for i in range(3))
    return found.select("vec_id", *(F.round(F.col("point")[i] - along * F.col("direction")[i], 3).alias(c) for i, c in enumerate("xyz")), *(F.round(F.abs(F.col("direction")[i]), 4).alias(c) for i, c in enumerate(("dx", "dy", "dz"))))


@query("best_combinations")
def best_combinations(spark, sf_dir):
    """Of three candidates in each of five views (the thing's end, its other end and a stray pixel) the combination that agrees on one place with the highest scores."""
    x, camera = _seen(spark, sf_dir)
    score = lambda n: F.pmod(F.xxhash64("vec_id", "view", F.lit(n)), F.lit(1000)) / 1000.0
    stray = F.array(score(7) * 1280, score(8) * 720)
    made = F.array(*(F.struct(F.lit(n).alias("kind"), at.alias("at"), (score(n) + more).alias("score")) for n, (at, more) in enumerate(((C.project(camera, F.col("p")), 0.2), (C.project(camera, F.col("q")), 0.0), (stray, 0.0)))))
    x = x.select("vec_id", "view", "turn", "shift", F.inline(made))
    entry = lambda i, j: F.col("turn")[3 * i + j] if j < 3 else F.col("shift")[i]
    focal = ((_LENS[0], _LENS[2]), (_LENS[1], _LENS[3]))
    matrix = F.array(*(entry(i, j) * focal[i][0] + entry(2, j) * focal[i][1] if i < 2 else entry(2, j) for i in range(3) for j in range(4)))
    x = x.select("vec_id", "view", F.concat_ws("-", "view", "kind").alias("name"), matrix.alias("camera"), F.col("at")[0].alias("u"), F.col("at")[1].alias("v"), "score", F.lit(1.0).alias("size"))
    found = combos.best_combinations(x, ["vec_id"], gate=12.0)
    return found.select("vec_id", *(F.round(c, 4).alias(c) for c in ("score", "x", "y", "z")), "names")
