"""Components, hulls and footprints against flood fill and full grids."""

import numpy as np
from pyspark.sql import functions as F

from sightline.operators import regions


def flood(image, diagonal):
    """Component of each set pixel, numbered as they are met."""
    left = {tuple(p) for p in np.argwhere(image)}
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    out = []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            p = todo.pop()
            part.add(p)
            for a, b in steps:
                q = (p[0] + a, p[1] + b)
                if q in left:
                    left.remove(q)
                    todo.append(q)
        out.append(part)
    return out


def test_components_are_those_of_flood_fill(spark):
    r = np.random.default_rng(1)
    images = [r.random((9, 13)) < p for p in r.uniform(0.05, 0.9, 60)]
    images += [np.zeros((9, 13), bool), np.ones((9, 13), bool), np.indices((9, 13)).sum(0) % 2 == 0]
    spiral = np.zeros((9, 13), bool)
    spiral[::4] = True
    spiral[2, 1:] = spiral[6, :-1] = spiral[1:3, 12] = spiral[3:5, 1] = True
    images.append(spiral)
    rows = [(i, [int(p) for p in np.flatnonzero(x)]) for i, x in enumerate(images)] + [(900, None)]
    df = spark.createDataFrame(rows, "id long, mask array<long>").withColumn("kept_", F.lit("clash")).select("id", "kept_", "mask", regions.runs_of(F.col("mask"), 13).alias("runs"))
    assert all(x.back == x.mask for x in df.select("mask", regions.pixels_of(F.col("runs"), 13).alias("back")).collect())
    for diagonal in (True, False):
        for share in (0.0, 0.3, 1.0):
            found = regions.kept_components(df, "runs", share, diagonal).select("id", "components", "dropped", "runs", "kept", regions.pixels_of(F.col("kept"), 13).alias("pixels")).collect()
            for x in found:
                if x.id == 900:
                    assert (x.components, x.dropped, x.kept, x.runs) == (0, 0, None, None)
                    continue
                parts = flood(images[x.id], diagonal)
                most = max(map(len, parts), default=0)
                stay = {p for part in parts if len(part) >= share * most for p in part}
                assert x.components == len(parts) and x.pixels == sorted(a * 13 + b for a, b in stay)
                assert x.dropped == images[x.id].sum() - len(stay)
    assert regions.kept_components(df.limit(0), "runs").count() == 0


def test_long_chains_of_runs_are_one_component():
    n = 5000  # stairs
    assert set(regions.labels(np.zeros(n, int), np.arange(n), np.arange(n), np.arange(n))) == {0}
    assert len(set(regions.labels(np.zeros(n, int), np.arange(n), np.arange(n), np.arange(n), diagonal=False))) == n


def cameras():
    out = []
    for angle in (0.0, 0.9, 2.1):
        c, s = np.cos(angle), np.sin(angle)
        turn = np.array([[c, 0, -s], [0, 1, 0], [s, 0, c]])
        lens = np.array([[60.0, 0, 32], [0, 60.0, 24], [0, 0, 1]])
        out.append(lens @ np.hstack([turn, [[0.1], [0.2], [6.0 if angle < 2 else 1.0]]]))  # the last stands inside the grid
    return out


def test_hull_is_that_of_the_full_grid(spark):
    r = np.random.default_rng(3)
    origin, cell, levels = (-2.0, -2.1, -1.9), 0.25, 4
    rows, want = [], {}
    for moment in range(8):
        masks = [r.random((48, 64)) < p for p in (0.9, 0.5, 0.97)]
        if moment == 1:
            masks[2][:] = False
        grid = np.indices((16, 16, 16)).reshape(3, -1).T
        alive = np.ones(len(grid), bool)
        for k, (m, c) in enumerate(zip(masks, cameras())):
            if moment == 2 and k == 1:
                rows.append((moment, None, 64, 48, [1]))
                continue
            x = (np.array(origin) + (grid + 0.5) * cell) @ c[:, :3].T + c[:, 3]
            with np.errstate(all="ignore"):
                u, v = np.floor(x[:, 0] / x[:, 2]), np.floor(x[:, 1] / x[:, 2])
            ok = (x[:, 2] > 1e-9) & (u >= 0) & (u < 64) & (v >= 0) & (v < 48)
            ok[ok] = m[v[ok].astype(int), u[ok].astype(int)]
            alive &= ok
            rows.append((moment, c.ravel().tolist(), 64, 48, [int(p) for p in np.flatnonzero(m)]))
        want[moment] = {tuple(map(int, p)) for p in grid[alive]}
    df = spark.createDataFrame(rows, "moment long, camera array<double>, width int, height int, pixels array<long>")
    found = {m: set() for m in want}
    for x in regions.hulls(df, ["moment"], origin, cell, levels).collect():
        found[x.moment].add((x.x, x.y, x.z))
    assert found == want and want[0] and not want[1]
    counts = {x.moment: x for x in regions.hulls(df, ["moment"], origin, cell, levels, cells=False).collect()}
    assert {m: x.cells for m, x in counts.items()} == {m: len(x) for m, x in want.items()} and counts[2].views == 2 and counts[0].views == 3


def test_few_cells_are_looked_at():
    """A small mask leaves most of the grid at coarse levels."""
    table = regions._sums([24 * 64 + 32, 24 * 64 + 33], 64, 48)
    found, seen = regions.carved([table] * 2, cameras()[:2], np.array([-2.0, -2.0, -2.0]), 4 / 64, 6, lot=64)
    assert 0 < sum(map(len, found)) and seen < 0.1 * 64**3
    full, all_seen = regions.carved([table] * 2, cameras()[:2], np.array([-2.0, -2.0, -2.0]), 4 / 64, 6)
    assert all_seen == seen and {tuple(p) for x in full for p in x} == {tuple(p) for x in found for p in x}


def test_footprints(spark):
    above = [float(x) for x in (100, 0, 32, 320, 0, 100, 24, 240, 0, 0, 0.1, 10)]
    at = lambda x, y: ((100 * x + 320) / 10, (100 * y + 240) / 10)
    box = lambda a, b, c, d: [*at(a, b), *at(c, d)]
    rows = [("a", v, above, box(-2, -1, 2, 1), None) for v in range(3)] + [("few", v, above, box(0, 0, 1, 1), None) for v in range(2)]
    rows += [("apart", v, above, box(*(x + 5 * v for x in (-2, -1, -1, 1))), None) for v in range(3)]
    df = spark.createDataFrame(rows, "thing string, view int, camera array<double>, box array<double>, seed array<double>")
    (x,) = regions.footprints(df, ["thing"], 8.0, 0.5, seed="seed").collect()
    assert (x.thing, x.cells, x.bounds, x.centre) == ("a", 32, [-2.0, -1.0, 2.0, 1.0], [0.0, 0.0]) and sum(r.last - r.first + 1 for r in x.runs) == 32
    many = [("still", 0, [10.0 + k % 3, 10.0, 30.0 + k % 3, 30.0]) for k in range(12)] + [("moves", 0, [10.0 * k, 10.0, 10.0 * k + 5, 30.0]) for k in range(12)] + [("rare", 0, [1.0, 1.0, 9.0, 9.0])] * 9 + [("still", 0, None)]
    steady = regions.stable_boxes(spark.createDataFrame(many, "thing string, view int, box array<double>"), ["thing"], "view", "box").collect()
    assert [(x.thing, x.box) for x in steady] == [("still", [11.0, 10.0, 31.0, 30.0])]
