"""Lines in several views against fits written out one group at a time."""

import numpy as np
import pytest

from sightline.operators import lines

LENS = (800.0, 820.0)


def looking(angle):
    """turn and centre of a camera that looks at the origin from 50 away."""
    c, s = np.cos(angle), np.sin(angle)
    turn = np.array([[c, 0, -s], [0, 1, 0], [s, 0, c]])
    return turn, turn.T @ np.array([0, 0, -50.0])


def seen(turn, centre, point):
    x = turn @ (np.asarray(point, float) - centre)
    return x[:2] / x[2]


def view(name, angle, p, q, weight=1.0, compact=False, off=(0.0, 0.0)):
    turn, centre = looking(angle)
    one, other = (seen(turn, centre, x) + np.array(off) / LENS for x in (p, q))
    middle = seen(turn, centre, (np.asarray(p) + q) / 2) + np.array(off) / LENS
    return {"view": name, "weight": weight, "lens": list(LENS), "turn": turn.ravel().tolist(), "centre": centre.tolist(), "one": None if compact else one.tolist(), "other": None if compact else other.tolist(), "middle": middle.tolist()}


def brute(group, angle=10.0):
    """point on the line and its direction, from stacked rows by singular values and least squares."""
    planes, rays = [], []
    for v in group:
        turn, centre = np.reshape(v["turn"], (3, 3)), np.array(v["centre"])
        to = lambda x: turn.T @ np.append(x, 1.0)
        if v["one"] is not None:
            n = np.cross(to(v["one"]), to(v["other"]))
            n /= np.linalg.norm(n)
            planes.append((n, n @ centre, v["weight"]))
        else:
            d = to(v["middle"])
            rays.append((centre, d / np.linalg.norm(d), v["weight"]))
    rows = []
    for i, (n, _, w) in enumerate(planes):
        others = [(m, u) for j, (m, _, u) in enumerate(planes) if j != i]
        rows.append(w * np.sqrt(sum(u * (1 - (n @ m) ** 2) for m, u in others) / sum(u for _, u in others)) * n)
    along = np.linalg.svd(np.array(rows))[2][-1]
    basis = np.linalg.svd(along[None])[2][1:].T
    a = [w * (basis.T @ n) for n, _, w in planes]
    b = [w * d for _, d, w in planes]
    for c, d, w in rays:  # with its own distance along the ray as an unknown, taken out by the normal
        m = np.cross(along, d)
        m /= np.linalg.norm(m)
        a.append(w * (basis.T @ m))
        b.append(w * (m @ c))
    return basis @ np.linalg.lstsq(np.array(a), np.array(b), rcond=None)[0], along


def apart(at, along, x):
    return np.linalg.norm(np.cross(along, x - at))


def groups(seed=2, n=40, noise=0.5):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        p = r.uniform(-4, 4, 3)
        q = p + r.normal(size=3) * 5
        out.append(([view(f"v{k}", a, p, q, r.uniform(0.5, 2), k == 4, r.normal(size=2) * noise) for k, a in enumerate((-1.0, -0.4, 0.2, 0.9, 0.5))], p, q))
    return out


def test_fit_is_that_of_stacked_rows():
    made = groups()
    views = lines.Views([g for g, _, _ in made])
    found = lines.Lines(views, views.plane | views.point, lines.Rules(angle=0.0))
    for i, (g, _, _) in enumerate(made):
        at, along = brute(g)
        assert abs(abs(found.along[i] @ along) - 1) < 1e-9 and apart(found.at[i], found.along[i], at) < 1e-6
    exact = groups(noise=0.0)
    views = lines.Views([g for g, _, _ in exact])
    found = lines.fitted(views, lines.Rules(gate=1.0, angle=1.0))
    for i, (_, p, q) in enumerate(exact):
        assert found.known[i] and max(apart(found.at[i], found.along[i], x) for x in (p, q)) < 1e-6
        ends = sorted([(p - found.at[i]) @ found.along[i], (q - found.at[i]) @ found.along[i]])
        assert np.allclose(ends, [found.low[i], found.high[i]], atol=1e-6)
    assert np.nanmax(found.residuals()[0]) < 1e-6


def test_left_out_is_a_fit_of_the_others():
    made = groups(5, 15)
    told = lines.held_out(lines.Views([g for g, _, _ in made]), lines.Rules(angle=0.0))
    for i, (g, _, _) in enumerate(made):
        for k in range(4):
            at, along = brute(g[:k] + g[k + 1 :])
            v = g[k]
            turn, centre = np.reshape(v["turn"], (3, 3)), np.array(v["centre"])
            a, b = (seen(turn, centre, at + t * along) * LENS for t in (-3.0, 3.0))
            unit = (b - a) / np.linalg.norm(b - a)
            ends = [np.array(v[n]) * LENS for n in ("one", "other")]
            away = np.mean([abs((e - a) @ [-unit[1], unit[0]]) for e in ends])
            axis = (ends[1] - ends[0]) / np.linalg.norm(ends[1] - ends[0])
            assert told["known"][i, k] and abs(told["pixels"][i, k] - away) < 1e-5
            assert abs(told["degrees"][i, k] - np.degrees(np.arccos(min(1, abs(axis @ unit))))) < 1e-4


def frame(spark, made):
    rows = [(i, *(v[c] for c in ("view", "weight", *lines.FIELDS))) for i, g in made for v in g]
    return spark.createDataFrame(rows, "thing long, view string, weight double, " + ", ".join(f"{c} array<double>" for c in lines.FIELDS))


def test_views_are_dropped_and_lengths_completed(spark):
    p, q = np.array([-2.0, -5.0, 1.0]), np.array([2.0, 5.0, -1.0])
    angles = (-1.0, -0.4, 0.2, 0.9)
    good = [view(f"v{k}", a, p, q) for k, a in enumerate(angles)]
    size = float(np.linalg.norm(q - p))
    bad = [*good[:3], view("v3", 0.9, p, q, off=(90.0, -40.0))]
    long = [*good[:3], view("v3", 0.9, p - 2 * (q - p), q)]
    half = [view(f"v{k}", a, p, (p + q) / 2) if k else view("v0", a, p, p + 0.3 * (q - p)) for k, a in enumerate(angles)]
    made = [(0, good), (1, bad), (2, long), (3, half), (4, good[:1]), (5, [good[0], bad[3]]), (6, [good[0], *(view(f"c{k}", a, x - 0.01, x + 0.01, compact=True) for k, (a, x) in enumerate(((0.9, p), (0.2, q))))]), (7, [])]
    made.append((8, [*good, {**good[0], "weight": 0.5, "one": [0.0, 0.0]}, {**good[0], "view": None}, {**good[1], "view": "none", "weight": None}]))
    rules = lines.Rules(gate=5.0, angle=5.0, length=size, gap=3.0)
    found = {x.thing: x for x in lines.line_fits(frame(spark, made), ["thing"], rules).collect()}
    assert set(found) == {0, 1, 2, 3, 5, 6, 8}  # two planes always meet
    for i in (0, 1, 2, 6, 8):
        x = found[i]
        ends = [np.array(x.point) + t * np.array(x.direction) for t in (x.low, x.high)]
        assert max(apart(np.array(x.point), np.array(x.direction), e) for e in (p, q)) < (0.2 if i == 6 else 1e-6)
        assert i == 6 or abs(np.linalg.norm(ends[1] - ends[0]) - size) < 1e-6
    assert (found[1].dropped, found[2].dropped, found[8].dropped) == (["v3"], ["v3"], []) and found[0].views == ["v0", "v1", "v2", "v3"]
    x = found[3]
    assert x.completed and abs(x.high - x.low - size) < 1e-6 and abs(found[8].point[0] - found[0].point[0]) < 1e-9
    grown = [np.array(x.point) + t * np.array(x.direction) for t in (x.low, x.high)]
    assert min(np.linalg.norm(e - p) for e in grown) < 1e-6 and min(np.linalg.norm(e - q) for e in grown) < 1e-6
    out = lines.lines_left_out(frame(spark, made[:5]), ["thing"]).collect()
    assert sum(x.thing == 4 for x in out) == 1 and all(x.pixels is None for x in out if not x.fitted) and all(x.pixels < 1e-6 for x in out if x.thing == 0)
    assert lines.line_fits(frame(spark, made).limit(0), ["thing"]).count() == 0


@pytest.mark.parametrize("angle", [0.5, 30.0])
def test_planes_that_hardly_cross_give_no_line(angle):
    p, q = np.array([0.0, -5.0, 0.0]), np.array([0.0, 5.0, 0.0])
    views = lines.Views([[view("a", 0.0, p, q), view("b", 0.1, p, q)]])
    assert lines.fitted(views, lines.Rules(angle=angle)).known.tolist() == [angle < 5]
