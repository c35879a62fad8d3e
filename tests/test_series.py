"""Measures along tracks and shapes against brute force."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.functions import shapes
from sightline.operators import series


def test_local_fit_and_its_ends(spark):
    r = random.Random(1)
    rows = [(k, i, r.random()) for k, n in enumerate((1, 4, 5, 12)) for i in range(n)]
    got = {(x.k, x.i): x.smoothed for x in series.local_fit(spark.createDataFrame(rows, "k int, i int, v double"), ["k"], "i", "v", 5, 2).collect()}
    for k, n in enumerate((1, 4, 5, 12)):
        v = [x[2] for x in rows if x[0] == k]
        for i in range(n):
            if n < 5:
                full = [0, 0, *v, 0, 0]
                want = np.polyval(np.polyfit(range(5), full[i : i + 5], 2), 2)
            else:
                a = min(max(i - 2, 0), n - 5)
                want = np.polyval(np.polyfit(range(5), v[a : a + 5], 2), i - a)
            assert abs(got[k, i] - want) < 1e-9


def test_flips(spark):
    # step, state, held, in the rack, in the trash
    rows = [(1, 0, None, False, True, False), (1, 1, False, False, False, False), (1, 2, True, True, False, False), (1, 3, None, True, False, True), (1, 8, False, False, False, False), (1, 10, False, False, False, True)]
    rows += [(2, 0, True, False, False, False), (2, 1, None, False, True, False), (2, 2, True, False, True, False), (2, 3, False, False, False, False)]
    df = spark.createDataFrame(rows, "k int, at long, state boolean, held boolean, rack boolean, bin boolean")
    got = {(x.k, x.at): (x.kind, x.before, x.target, x.frames, x.first) for x in series.flips(df, ["k"], "at", "state", "held", {"rack": F.col("rack")}, {"bin": F.col("bin")}, reach=5).collect()}
    assert got == {(1, 2): ("on", False, "rack", 1, 0), (1, 8): ("off", True, "bin", 1, 3), (2, 0): ("on", None, None, None, None), (2, 3): ("off", True, None, None, None)}
    late = df.withColumn("at", F.when(F.col("at") >= 8, F.col("at") + 1).otherwise(F.col("at")))  # the held row is too far back: around the flip itself
    assert {(x.k, x.at): x.first for x in series.flips(late, ["k"], "at", "state", "held", {"rack": F.col("rack")}, {"bin": F.col("bin")}, reach=5).collect()}[1, 9] == 11


def test_onsets(spark):
    bad = [0, 1, 1, 0, 1, 1, 0, 0, 0, 1, 0, 0, 1, 1, 1]
    df = spark.createDataFrame([("a", i, float(i), b, 1 if i == 1 else 3) for i, b in enumerate(bad)], "k string, at long, e double, b int, n long")
    got = [tuple(x) for x in series.onsets(df, ["k"], "at", F.col("b") == 1, "e", "n", 2, 1, 3, 2).orderBy("start").collect()]
    assert got == [("a", 1, 6, 2, 1.0, 5.0, 1, "1 agree, 2 required"), ("a", 12, 15, 1, 12.0, 14.0, 3, None)]


def test_sets_of_steps(spark):
    r = random.Random(4)
    rows = [(r.randrange(3), r.randrange(60)) for _ in range(25)]
    df = spark.createDataFrame(rows, "k int, at long")
    want = {(k, a + d) for k, a in rows for d in range(-2, 3) if 5 <= a + d < 50}
    got = [tuple(x) for x in series.dilated(df, ["k"], "at", 2, 5, 50).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    cuts = series.boundaries(spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 2, None), (1, 3, None), (1, 4, "b")], "k int, at int, l string"), ["k"], "at", "l").orderBy("at").collect()
    assert [(x.at, x.before, x.l) for x in cuts] == [(2, "a", None), (4, None, "b")]


def test_moved_needs_two_views_or_all(spark):
    rows = [("x", v, t, [float(p), 0.0]) for v, path in (("a", (0, 9, 9)), ("b", (0, 9, 18)), ("c", (0, 0, 0))) for t, p in enumerate(path)] + [("y", "a", 0, [0.0, 0.0]), ("y", "a", 1, [9.0, 0.0]), ("y", "b", 1, [0.0, 0.0]), ("y", "b", 3, [50.0, 0.0])]
    got = {(x.k, x.t): x.views for x in series.moved(spark.createDataFrame(rows, "k string, v string, t int, p array<double>"), ["k"], "v", "t", F.col("p"), F.lit(5.0)).collect()}
    assert got == {("x", 1): ["a", "b"], ("y", 1): ["a"]}


def test_nested_keeps_the_longer(spark):
    r = random.Random(7)
    rows = [(t, s, r.randrange(4)) for t in range(12) for s in range(20) if r.random() < 0.2 + t / 14]
    got = {(x.t, x.kept): (x.steps, x.nested) for x in series.nested(spark.createDataFrame([("c", *x) for x in rows], "k string, t int, s int, b int"), ["k"], "t", "s", F.abs(F.col("_a.b") - F.col("_b.b")) <= 1, often=0.55).collect()}
    at = {t: {s: b for x, s, b in rows if x == t} for t in range(12)}
    order, gone, want = sorted(at, key=lambda t: (-len(at[t]), t)), set(), {}
    for i, keeper in enumerate(order):
        for other in order[i + 1 :]:
            both = at[keeper].keys() & at[other].keys()
            if keeper in gone or other in gone or len(both) < max(5, 0.5 * min(len(at[keeper]), len(at[other]))):
                continue
            share = sum(abs(at[keeper][s] - at[other][s]) <= 1 for s in both) / len(both)
            if share >= 0.55:
                gone.add(other)
                want[other, keeper] = (len(both), share)
    assert got == want and want


@pytest.mark.parametrize("often", [0.3, 0.95])
def test_nested_by_blocks_is_all_pairs_in_order(spark, often):
    r = random.Random(11)
    rows = [(k, f"t{t:02d}", s, r.randrange(9)) for k, n in (("many", 45), ("few", 3)) for t in range(n) for s in range(12) if r.random() < 0.9]
    rows += [(k, "t99", s, b) for k, t, s, b in rows if t == "t02"] + [(None, t, s, b) for k, t, s, b in rows if k == "few"] + [("few", None, s, 1) for s in range(12)]
    df = spark.createDataFrame(rows, "k string, t string, s int, b int")
    got = {(x.k, x.t): (x.kept, x.steps, x.nested) for x in series.nested(df, ["k"], "t", "s", F.col("_a.b") - F.col("_b.b") <= 2, often=often, block=2).collect()}
    want = {}
    for key in ("many", "few"):
        at = {t: {s: b for k, x, s, b in rows if (k, x) == (key, t)} for t in {t for k, t, _, _ in rows if k == key and t}}
        order = sorted(at, key=lambda t: (-len(at[t]), t))
        for i, keeper in enumerate(order):
            for other in order[i + 1 :]:
                both, (a, b) = at[keeper].keys() & at[other].keys(), sorted((keeper, other))
                if (key, keeper) not in want and (key, other) not in want and len(both) >= 5:
                    share = sum(at[a][s] - at[b][s] <= 2 for s in both) / len(both)
                    if share >= often:
                        want[key, other] = (keeper, len(both), share)
    assert got == want and want


def test_nearest_in_order(spark):
    r = random.Random(8)
    rows = [(k, r.random() < 0.5, i, [r.random(), r.random()]) for k in range(6) for i in range(k)]
    got = {tuple(x) for x in series.nearest_in_order(spark.createDataFrame(rows, "k int, side boolean, item long, p array<double>"), ["k"], "side", "item", "p").collect()}
    want = set()
    for k in range(6):
        left, right = ([x for x in rows if x[0] == k and x[1] is s] for s in (True, False))
        for _, _, i, p in left:
            best = min(right, key=lambda x: (math.dist(p, x[3]), x[2]), default=None)
            want.add((k, i, best and best[2]))
            right = [x for x in right if x is not best]
        want |= {(k, None, x[2]) for x in right}
    assert got == want


def test_ensemble_choices(spark):
    box = list(range(20))
    rows = [
        (0, box, None, None, False, True),  # nothing against it
        (1, box[:4], box, None, False, True),  # small: the fallback
        (2, box[:4], box, None, False, False),  # outside the policy the primary stands whatever the rules say
        (3, None, [], None, False, True),
        (4, [900], [901], None, False, True),  # small and apart, and so is the fallback
        (5, box, box, None, True, True),
        (6, box, box[:18], [box], False, True),  # on another target
        (7, [], None, None, False, False),
    ]
    df = spark.createDataFrame([("t", *x) for x in rows], "k string, frame long, primary array<long>, fallback array<long>, others array<array<long>>, hidden boolean, inside boolean")
    got = [(x.choice, x.fired) for x in series.ensemble_choices(df, ["k"], 30, samples=1, window=90).orderBy("frame").collect()]
    assert got == [("primary", ""), ("fallback", "small"), ("primary", "small"), ("missing", "missing"), ("unsane", "small,apart"), ("hidden", ""), ("fallback", "other"), ("missing", "missing")]
    assert len(series.ensemble(pd.DataFrame(columns=["frame", "primary", "fallback", "others", "hidden", "inside"]), 30)) == 0


def test_shapes(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c.alias("x")).first().x

    def a(*xs):
        return F.array(*(F.lit(float(x)) for x in xs))

    square = F.array(a(0, 0), a(2, 0), a(2, 2), a(0, 2))
    assert value(shapes.inside_convex(a(1, 1), square)) and value(shapes.inside_convex(a(2, 1), F.reverse(square)))
    assert not value(shapes.inside_convex(a(3, 1), square)) and not value(shapes.inside_convex(a(0, 0), F.array(a(0, 0), a(1, 1))))
    assert value(shapes.to_box(a(5, 6), a(0, 0, 2, 2))) == 5.0 and value(shapes.to_box(a(1, 1), a(0, 0, 2, 2))) == 0.0
    assert tuple(value(shapes.along_across(a(5, 3, 0), a(2, 0, 0), a(0, 0, 0)))) == (3.0, 3.0) and value(shapes.along_across(a(5, 3, 0), a(2, 0, 0), a(2, 0, 0))) is None
    assert value(shapes.angle(a(1, 0), a(-1, 0))) == 180.0 and value(shapes.angle(a(1, 0), a(-1, 0), True)) == 0.0 and value(shapes.angle(a(0, 0), a(1, 0))) is None
    assert tuple(value(shapes.line_distance(a(0, 0, 0), a(1, 0, 0), a(0, 2, 0), a(1, 0, 0)))) == (0.0, 2.0, 2.0)
    assert [tuple(value(shapes.clamped_interval(F.lit(0.0), F.lit(10.0), F.lit(x), F.lit(y), 4.0))) for x, y in ((2, 1), (1, 2), (1, 1))] == [(0.0, 4.0, True), (6.0, 10.0, True), (3.0, 7.0, True)]
    assert [value(shapes.view_of(F.lit(v))) for v in ("static-c10", "ego-hmc21", "x")] == ["C10", "HMC_21", ""]
    assert [value(shapes.seconds_of(F.lit(t))) for t in ("0, 1.5,2", "1,1", "2,1", "-1", "a", ",", None)] == [[0.0, 1.5, 2.0], None, None, None, None, None, None]
    assert value(shapes.relative_to(F.lit("/r/a"), "/r/")) == "a" and value(shapes.source_seconds(F.lit(30), 60.0, 1.0, 2.0)) == 2.0
