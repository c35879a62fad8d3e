"""Motion of a view against a fold over its frames."""

import numpy as np
from pyspark.sql import functions as F

from sightline.operators import motion


def test_maps_products_and_what_moves_against_them(spark):
    r = np.random.default_rng(1)
    rows, truth = [], {}
    for key, n in (("a", 40), ("b", 7), (None, 3)):
        points = {i: r.uniform(50, 500, 2) for i in range(14)}
        whole = np.eye(3)
        frames = sorted(r.choice(np.arange(-20, 90), n, replace=False).tolist())
        for k, f in enumerate(frames):
            if k:
                t = r.normal(0, 0.01)
                step = np.array([[1 + r.normal(0, 0.01), -t, r.normal(0, 6)], [t, 1 + r.normal(0, 0.01), r.normal(0, 6)], [0, 0, 1]])
                whole = step @ whole
            truth[key, f] = whole
            for i, p in points.items():
                at = (whole @ [*p, 1])[:2] + (k * np.array([9.0, -7.0]) if i == 13 else 0)  # the last one moves by itself
                rows.append((key, f, i, float(at[0]), float(at[1])))
    df = spark.createDataFrame(rows, "k string, f long, item long, x double, y double")
    steps = motion.step_maps(df.filter("k is not null"), ["k"], "f", "item", "x", "y").cache()
    for block in (4, 10_000):
        got = {(x.k, x.f): np.reshape(x.whole, (3, 3)) for x in motion.composed(steps, ["k"], "f", block=block).collect()}
        assert len(got) == 47 and all(np.allclose(m, truth[key], atol=1e-5) for key, m in got.items())
    serial = {}
    for x in sorted(steps.collect(), key=lambda x: (x.k, x.f)):
        serial[x.k] = np.reshape(x.map, (3, 3)) @ serial.get(x.k, np.eye(3))
        assert np.allclose(got[x.k, x.f], serial[x.k]) and (x.before is None) == (x.shared == 0)
    wholes = motion.composed(steps, ["k"], "f", block=32)
    frames = sorted(f for k, f in truth if k == "a")
    moves = []
    for item in (2, 13):
        at = {f: (x, y) for k, f, i, x, y in rows if k == "a" and i == item}
        moves += [("a", frames[3], frames[30], *at[frames[3]], *at[frames[30]], item), ("a", frames[30], frames[3], *at[frames[30]], *at[frames[3]], item)]
    moves.append(("a", -500, -400, 1.0, 1.0, 4.0, 5.0, 99))
    found = {(x.item, x.i): x.against for x in motion.against_scene(spark.createDataFrame(moves, "k string, i long, j long, xi double, yi double, xj double, yj double, item long"), wholes, ["k"], "f").collect()}
    assert all(found[2, f] < 1e-3 for f in (frames[3], frames[30])) and all(found[13, f] > 100 for f in (frames[3], frames[30])) and found[99, -500] == 5.0
    assert motion.composed(steps.limit(0), ["k"], "f").count() == 0


def test_few_points_and_movers():
    r = np.random.default_rng(2)
    p = r.uniform(0, 100, (4, 2))
    assert np.allclose(motion.robust_map(p, p + [3, -2]), [[1, 0, 3], [0, 1, -2], [0, 0, 1]]) and np.allclose(motion.robust_map(p[:2], p[:2] + 9), np.eye(3))
    p = r.uniform(0, 500, (20, 2))
    q = p @ np.array([[1.01, 0.02], [-0.02, 0.99]]).T + [5, 6]
    q[:4] += 60
    assert np.allclose(motion.robust_map(p, q), [[1.01, 0.02, 5], [-0.02, 0.99, 6], [0, 0, 1]], atol=1e-9)


def test_inverse(spark):
    m = np.array([[1.1, 0.2, 5], [-0.1, 0.9, 7], [0, 0, 1.0]])
    row = spark.range(1).select(motion.inverse(F.array(*(F.lit(float(v)) for v in m.ravel()))).alias("i"), motion.inverse(F.array(*(F.lit(0.0) for _ in range(9)))).alias("none")).first()
    assert np.allclose(np.reshape(row.i, (3, 3)), np.linalg.inv(m)) and row.none is None
