"""The best combination of candidates against the full product."""

import itertools

import numpy as np

from sightline.operators import combos

LENS = np.array([[800.0, 0, 640], [0, 800.0, 360], [0, 0, 1]])


def camera(angle):
    c, s = np.cos(angle), np.sin(angle)
    return LENS @ np.hstack([[[c, 0, -s], [0, 1, 0], [s, 0, c]], [[0], [0], [50.0]]])


def rig(seed, k=4, spread=3.0, views=(-0.9, -0.3, 0.4, 1.0)):
    """Candidates of a true place and of others, by view."""
    r = np.random.default_rng(seed)
    places = r.uniform(-8, 8, (k, 3))
    out = []
    for n, a in enumerate(views):
        c, own = camera(a), []
        for i, p in enumerate(places):
            x = c @ [*p, 1]
            if r.random() < 0.85:
                own.append((float(np.round(r.random() + 0.3 * (i == 0), 3)), f"v{n}-{i}", c, *(x[:2] / x[2] + r.normal(0, spread, 2)), float(r.uniform(1, 3))))
        if own:
            out.append(sorted(own, key=lambda x: (-x[0], x[1])))
    return out


def product(views, gate, band, least):
    check, best = combos.Candidates(views, gate, band, least), None
    for some in itertools.product(*([None, *v] for v in views)):
        chosen = [c for c in some if c]
        if len(chosen) >= least and all(check.pair(a, b) for a, b in itertools.combinations(chosen, 2)) and check.whole(chosen) is not None:
            rank = (-round(sum(c[0] for c in chosen), 9), -len(chosen), sorted(c[1] for c in chosen))
            best = min(best, rank) if best else rank
    return best, check.looked_at


def test_search_is_the_full_product():
    work = [0, 0]
    hits = 0
    for seed in range(60):
        views = rig(seed, k=2 + seed % 4)
        if len(views) < 3:
            continue
        gate, band = (8.0, 25.0, 60.0)[seed % 3], ((0.5, 2.0), (0.1, 9.0))[seed % 2]
        search = combos.Candidates(views, gate, band, 3)
        found = search.search()
        want, all_looks = product(views, gate, band, 3)
        assert (found is None) == (want is None)
        if found:
            hits += 1
            assert (-round(found[0], 9), -len(found[1]), sorted(c[1] for c in found[1])) == want
        work[0] += search.looked_at
        work[1] += all_looks
    assert hits > 20 and work[0] < work[1]


def test_much_less_is_looked_at_with_many_candidates():
    views = rig(3, k=8, spread=0.5)
    search = combos.Candidates(views, 10.0, (0.1, 9.0), 3)
    assert search.search() is not None and search.looked_at < 0.2 * np.prod([len(v) + 1 for v in views])


def test_groups(spark):
    rows = [(g, c[1].split("-")[0], c[1], c[2].ravel().tolist(), float(c[3]), float(c[4]), c[0], c[5]) for g in range(12) for v in rig(g) for c in v]
    rows += [(50, "v0", "lone", rows[0][3], 1.0, 1.0, 1.0, 1.0), (51, None, "x", rows[0][3], 1.0, 1.0, 1.0, 1.0), (0, "v0", "null", None, 1.0, 1.0, 99.0, 1.0)]
    df = spark.createDataFrame(rows, "g long, view string, name string, camera array<double>, u double, v double, score double, size double")
    got = {x.g: (round(x.score, 9), x.names) for x in combos.best_combinations(df, ["g"], gate=20.0, most=3).collect()}
    want = {}
    for g in range(12):
        views = [v[:3] for v in rig(g)]
        best = product(views, 20.0, (0.5, 2.0), 3)[0] if len(views) >= 3 else None
        if best:
            want[g] = (-best[0], best[2])
    assert got == want and len(want) > 3
    assert combos.best_combinations(df.limit(0), ["g"]).count() == 0
