"""Cameras and fits against numpy."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from sightline.functions import cameras
from sightline.operators import poses


def _lit(values):
    return F.array(*(F.lit(float(v)) for v in values))


def test_projection_and_rays(spark):
    camera = cameras.Camera(_lit((600, 620, 320, 240)), _lit((-0.1, 0.02, 0.001, -0.0005, 0.003)), cameras.turn_of(_lit((0.5, 0.5, 0.5, 0.5))), _lit((0.1, 0.2, 5)))
    r = random.Random(3)
    rows = [(i, [r.uniform(-1, 1) for _ in range(3)]) for i in range(20)] + [(20, None), (21, [-5.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "i int, p array<double>").withColumn("u", cameras.project(camera, F.col("p")))
    got = df.select("i", "p", "u", cameras.ray(camera, F.col("u")).alias("d"), camera.centre.alias("c"), cameras.plane_of_axis(camera, F.col("u"), F.col("u")).alias("same")).collect()
    for x in got:
        if x.p is None:
            assert x.u is None and x.d is None
        elif x.i < 20:
            way = np.array(x.p) - np.array(x.c)
            assert np.allclose(x.d, way / np.linalg.norm(way), atol=1e-5)
        assert x.same is None
    flat = df.where("i < 20").select(cameras.straightened(camera, F.array(F.lit(float("nan")), F.lit(1.0))).alias("s")).first().s
    assert math.isnan(flat[0])
    gap = cameras.epipolar_gap(F.col("c"), F.col("d"), cameras.Camera(camera.lens, camera.bend, cameras.turn_of(_lit((0.6, 0.8, 0, 0))), _lit((0, 1, 6))), F.col("t"))
    other = cameras.Camera(camera.lens, camera.bend, cameras.turn_of(_lit((0.6, 0.8, 0, 0))), _lit((0, 1, 6)))
    pairs = df.where("i < 20").select(camera.centre.alias("c"), cameras.ray(camera, F.col("u")).alias("d"), cameras.project(other, F.col("p")).alias("t"), cameras.seen_from(other, F.col("p")).alias("x"))
    near = [x for x in pairs.withColumn("gap", gap).collect() if x.x[2] > 3 and abs(x.x[0] / x.x[2]) < 0.5 and abs(x.x[1] / x.x[2]) < 0.5]
    assert near and all(x.gap < 0.05 for x in near)
    turn = spark.range(1).select(cameras.turn_between(cameras.turn_of(_lit((1, 0, 0, 0))), cameras.turn_of(_lit((math.cos(0.3), math.sin(0.3), 0, 0)))).alias("t")).first().t
    assert abs(turn - math.degrees(0.6)) < 1e-9


def test_similarity(spark):
    r = np.random.default_rng(1)
    angle = 0.7
    turn = np.array([[math.cos(angle), -math.sin(angle), 0], [math.sin(angle), math.cos(angle), 0], [0, 0, 1]])
    points = r.normal(size=(30, 3))
    rows = [("a", p.tolist(), (2.5 * turn @ p + [1, 2, 3]).tolist()) for p in points] + [("a", None, [1.0, 1.0, 1.0]), ("b", [0.0, 0.0, 0.0], [1.0, 1.0, 1.0])]
    rows += [("mirror", p.tolist(), (p * [1, 1, -1]).tolist()) for p in points] + [("c", [1.0, 1.0, 1.0], [2.0, float(i), 0.0]) for i in range(3)]
    got = {x.k: x for x in poses.similarity(spark.createDataFrame(rows, "k string, s array<double>, t array<double>"), ["k"], "s", "t").collect()}
    assert set(got) == {"a", "mirror", "c"}
    assert abs(got["a"].scale - 2.5) < 1e-9 and np.allclose(got["a"].turn, turn.ravel()) and np.allclose(got["a"].shift, [1, 2, 3])
    assert abs(np.linalg.det(np.array(got["mirror"].turn).reshape(3, 3)) - 1) < 1e-9
    assert got["c"].scale is None and got["c"].shift is None


def test_lowest_plane(spark):
    r = np.random.default_rng(2)
    points = r.normal(size=(200, 3)) * [5, 5, 1]
    down = np.array([0.0, 0.6, 0.8])
    df = spark.createDataFrame([("a", p.tolist()) for p in points] + [("a", None), ("b", [0.0, 0.0, 0.0])], "k string, p array<double>")
    got = poses.lowest_plane(df, ["k"], "p", _lit(down), 0.1, 2.0).collect()
    height = points @ down
    low = points[height >= np.quantile(height, 0.9)]
    normal = np.linalg.svd(low - low.mean(axis=0))[2][-1]
    normal = -normal if normal @ down > 0 else normal
    off = (low - low.mean(axis=0)) @ normal
    assert len(got) == 1
    x = got[0]
    assert np.allclose(x.normal, normal) and abs(x.offset - normal @ low.mean(axis=0)) < 1e-9 and (x.points, x.fitted) == (200, len(low))
    assert abs(x.rms - np.sqrt((off**2).mean())) < 1e-9 and abs(x.p95 - np.quantile(abs(off), 0.95)) < 1e-9
    assert abs(x.below - ((points @ normal - normal @ low.mean(axis=0)) < -2).mean()) < 1e-9


def test_left_out(spark):
    r = np.random.default_rng(5)
    rows, want = [], {}
    for k, n in enumerate((2, 3, 5)):
        views = []
        for v in range(n):
            turn = np.linalg.qr(r.normal(size=(3, 3)))[0]
            camera = np.diag([500, 500, 1]) @ np.column_stack([turn, turn @ r.normal(size=3) + [0, 0, 9]])
            x = camera @ [0.3, 0.1, 0.2, 1]
            views.append((camera, x[:2] / x[2] + r.normal(size=2)))
            rows.append((k, v, camera.ravel().tolist(), *views[-1][1].tolist()))
        for v in range(n):
            m = [p[i] * c[2] - c[i] for o, (c, p) in enumerate(views) if o != v for i in (0, 1)]
            x = views[v][0] @ np.linalg.svd(np.array(m))[2][-1]
            want[k, v] = np.linalg.norm(x[:2] / x[2] - views[v][1]) if n > 2 else None
    got = poses.left_out(spark.createDataFrame(rows, "k int, v int, camera array<double>, u double, w double").withColumnsRenamed({"v": "view", "w": "v"}), ["k"]).collect()
    assert len(got) == 10
    for x in got:
        assert (x.away is None) == (want[x.k, x.view] is None)
        assert x.away is None or abs(x.away - want[x.k, x.view]) < 1e-4 * max(1, want[x.k, x.view])


def test_text(spark):
    texts = ["a=1,2,3,4", " a = 1 ,2,3,4;fg=5,6;bg=7,8;fg=9,0", "=1,2,3,4", "a=1,2,3", "a=1,2,3,4;xx=1,2", "a=1,2,3,4;fg=1", "", None]
    got = [x.p for x in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(cameras.prompt(F.col("t")).alias("p")).collect()]
    assert [None if p is None else tuple(p) for p in got] == [("a", [1, 2, 3, 4], [], []), ("a", [1, 2, 3, 4], [[5, 6], [9, 0]], [[7, 8]]), *[None] * 6]
    items = ["n=/x/y.jsonl", "/x/run/tracks.jsonl", "/x/y.z.jsonl", "a/b=c.txt", "tracks.jsonl", ".hidden"]
    named = [tuple(x.p) for x in spark.createDataFrame([(i, t) for i, t in enumerate(items)], "i int, t string").orderBy("i").select(cameras.named_path(F.col("t")).alias("p")).collect()]
    assert named == [("n", "/x/y.jsonl"), ("run", "/x/run/tracks.jsonl"), ("y.z", "/x/y.z.jsonl"), ("b=c", "a/b=c.txt"), ("", "tracks.jsonl"), (".hidden", ".hidden")]


def test_offsets_and_claims(spark):
    rows = [("one", m, p) for m, p in (("a", 1.0), ("a", 9.0), ("a", 2.0), ("b", 3.0), ("c", 2.5))] + [("out", m, p) for m, p in (("a", 0.0), ("b", 1.0), ("c", 30.0))]
    rows += [("split", m, p) for m, p in (("a", 0.0), ("b", 30.0))] + [("none", "a", None), ("even", "a", 0.0), ("even", "b", 10.0), ("even", "c", 20.0)]
    got = {x.k: tuple(x)[1:] for x in poses.agreed_offset(spark.createDataFrame(rows, "k string, metric string, peak double"), ["k"], 4.0, 3).collect()}
    assert got == {"one": (2, 2.5, 1, None), "out": (0, 0.5, 3, "c"), "split": (None,) * 4, "even": (None,) * 4}
    claims = [("f", 1, 0, True, 2.0), ("f", 1, 1, True, 2.0), ("f", 1, 2, False, 9.0), ("f", 2, 0, True, 1.0), ("f", 3, 1, True, -1.0), ("f", 1, 3, True, -12.0)]
    out = {(x.pixel, x.slot): (x.contested, x.resolved) for x in poses.exclusive(spark.createDataFrame(claims, "k string, pixel int, slot int, present boolean, logit double"), ["k"], -8.0).collect()}
    assert out == {(1, 0): (True, 2.0), (1, 1): (True, -8.0), (1, 2): (False, 9.0), (2, 0): (False, 1.0), (3, 1): (False, -1.0), (1, 3): (False, -12.0)}
