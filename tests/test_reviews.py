"""Review measures, masks, matching and clusters against brute force."""

import itertools
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sightline.functions import masks
from sightline.operators import graph, islands, joins, matching, reviews, vectors


def test_assignment_is_the_cheapest():
    r = np.random.default_rng(3)
    for n, m in [(1, 1), (2, 4), (4, 2), (4, 4), (3, 6), (5, 5)]:
        for _ in range(20):
            cost = r.integers(0, 6, (n, m)).astype(float) - 2
            pairs = matching.assignment(cost)
            assert len(pairs) == min(n, m) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
            flat = cost if n <= m else cost.T
            best = min(sum(flat[i, p[i]] for i in range(len(flat))) for p in itertools.permutations(range(flat.shape[1]), len(flat)))
            assert sum(cost[p] for p in pairs) == best
    assert matching.assignment(np.zeros((0, 3))) == []


def test_match_groups_cuts_without_losing_pairs(spark):
    r = random.Random(9)
    rows = [(k, r.choice("ab"), i, float(r.randrange(200))) for k in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, side string, item long, at double")
    for optimal in (False, True):
        got = {(x.k, x.left, x.right) for x in matching.match_groups(df, ["k"], "side", "item", "at", 3.0, optimal).collect()}
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # pieces that go on in the next batch
        try:
            assert {(x.k, x.left, x.right) for x in matching.match_groups(df, ["k"], "side", "item", "at", 3.0, optimal).collect()} == got
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        for k in range(3):
            a, b = ([x for x in rows if x[0] == k and x[1] == s] for s in "ab")
            cost = np.abs(np.array([x[3] for x in a])[:, None] - np.array([x[3] for x in b])[None, :])
            mine = [(x, y) for g, x, y in got if g == k]
            place = {x[2]: i for s in (a, b) for i, x in enumerate(s)}
            assert all(cost[place[x], place[y]] <= 3 for x, y in mine)
            if optimal:
                whole = [p for p in matching.assignment(np.where(cost <= 3, cost, 1e9)) if cost[p] <= 3]
                assert len(mine) == len(whole) and sum(cost[place[x], place[y]] for x, y in mine) == sum(cost[p] for p in whole)
            else:
                assert {(place[x], place[y]) for x, y in mine} == set(matching.greedy(cost, 3.0))


def test_clusters_and_chains(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(500, i) for i in range(501, 560)] + [(i, i + 1) for i in range(600, 640)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {x.node: x.cluster for x in graph.clusters(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for x in up}
    rows = [(k, i, float(r.randrange(300))) for k in range(2) for i in range(k * 100, k * 100 + 60)]
    got = {x.node: x.cluster for x in graph.chains(spark.createDataFrame(rows, "k long, i long, v double"), ["k"], "v", "i", 4.0).collect()}
    up = {i: i for _, i, _ in rows}
    linked = [(a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and abs(a[2] - b[2]) < 4]
    for a, b in linked:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    assert got == {x: root(x) for e in linked for x in e}


def test_nothing_is_read_forwards(spark):
    rows = [(1, t, None if t % 6 else float(t)) for t in range(5000)]
    df = spark.createDataFrame(rows, "k long, t long, v double")
    got = {x.t: x.filled for x in islands.fill_bounded(df, ["k"], "t", "v").collect()}
    assert all(abs(v - t) < 1e-9 for t, v in got.items() if t <= 4998)
    right = df.filter("v is not null").select("k", "t", "v")
    found = {x.t: x.matched_at for x in joins.asof(df.select("k", "t"), right, ["k"], "t", "v", forward=True).collect()}
    assert all(found[t] == (-(-t // 6) * 6 if t <= 4998 else None) for t in range(5000))


def test_exemplars_in_blocks(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(60, 5))
    x[3], x[4] = x[5], 0.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    got = {}
    for row in vectors.top_exemplars(df, df.filter("id < 20"), 3).orderBy("query", "rank").collect():
        got.setdefault(row["query"], []).append((row.exemplar, row.similarity))
    unit = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), where=np.linalg.norm(x, axis=1, keepdims=True) > 0, out=np.full_like(x, np.nan))
    for q in range(60):
        cosine = {e: unit[q] @ unit[e] for e in range(20) if e != q}
        want = sorted(cosine, key=lambda e: (np.isnan(cosine[e]), -round(cosine[e], 12) if not np.isnan(cosine[e]) else 0, e))[:3]
        assert [e for e, _ in got[q]] == want
        assert all(s is None if np.isnan(cosine[e]) else abs(s - cosine[e]) < 1e-12 for e, s in got[q])


def test_spread_picks(spark):
    def by_hand(pool, count, spacing):
        pool, out = sorted(set(pool)), []
        aims = [pool[len(pool) // 2]] if count == 1 else [pool[int(i * (len(pool) - 1) / (count - 1) + 0.5)] for i in range(count)]
        for aim in aims:
            if left := [f for f in pool if all(abs(f - t) >= spacing for t in out)]:
                out.append(min(left, key=lambda f: (abs(f - aim), f)))
        return out

    r = random.Random(4)
    for _ in range(50):
        pool = [r.randrange(100) for _ in range(r.randrange(1, 40))]
        count, spacing = r.randrange(1, 8), r.randrange(1, 20)
        assert reviews.spread(np.array(pool), count, spacing) == by_hand(pool, count, spacing)
    assert reviews.spread(np.array([], int), 3, 2) == [] and reviews.spread(np.array([5, 9]), 1, 1, (9,)) == [5]


def test_merged_fragments():
    box = lambda x: [x, 0.0, x + 10.0, 10.0]
    rows = pd.DataFrame(
        [(i, a, b, *box(x), *box(z)) for i, a, b, x, z in [(1, 0, 4, 0, 2), (2, 6, 9, 3, 3), (3, 30, 33, 3, 3), (4, 6, 8, 50, 50), (5, 11, 12, 4, 4), (6, 10, 12, 51, 90)]],
        columns=["piece", "first", "last", *(f"{n}{i}" for n in "az" for i in range(4))],
    )
    got = reviews.merge_fragments(rows, 5, 0.5).set_index("piece")["object"].to_dict()
    assert got == {1: 1, 2: 1, 5: 1, 3: 3, 4: 4, 6: 4}
    assert len(reviews.merge_fragments(rows.iloc[:0], 5, 0.5)) == 0


def test_masks(spark):
    df = spark.createDataFrame([([0, 1, 25], [1, 25, 26]), ([], [1]), (None, [2]), ([], []), (None, None)], "a array<long>, b array<long>")
    a, b = F.col("a"), F.col("b")
    got = df.select(masks.area(a), masks.iou(a, b), masks.iou(a, b, 1.0), masks.agreement(a, b), masks.overlap(a, b), masks.centroid(a, 24)).collect()
    assert [tuple(x) for x in got] == [(3, 0.5, 0.5, 0.5, 2 / 3, [2 / 3, 1 / 3]), (0, 0.0, 0.0, 0.0, 0.0, None), (0, None, None, 0.0, 0.0, None), (0, None, 1.0, None, 0.0, None), (0, None, None, None, 0.0, None)]
    lists = spark.createDataFrame([("3-5, 1,10:20:4,4",), ("",), (None,), ("7:7:2",)], "s string").select(masks.frame_list(F.col("s")).alias("f")).collect()
    assert [x.f for x in lists] == [[1, 3, 4, 5, 10, 14, 18], [], None, []]


def test_jitter_and_contacts(spark):
    r = random.Random(8)
    rows = [(k, t, 1000 * k + 10 * t + i, float(r.randrange(50))) for k in range(2) for t in range(12) if t != 5 for i in range(r.randrange(1, 5))]
    got = {x.i: x.moved for x in reviews.nearest_previous(spark.createDataFrame(rows, "k long, t long, i long, v double"), ["k"], "t", "i", "v").collect()}
    for k, t, i, v in rows:
        before = [abs(v - w) for k2, t2, _, w in rows if k2 == k and t2 == t - 1]
        assert got[i] == (min(before) if before else None)
    states = [(1, t, s) for t, s in enumerate([True, True, False, True, None, True]) if t != 9] + [(1, 8, True), (1, 10, False)]
    got = [(x.start, x.stop, x.closed) for x in reviews.contact_intervals(spark.createDataFrame(states, "k long, t long, s boolean"), ["k"], "t", "s").orderBy("start").collect()]
    assert got == [(0, 2, True), (3, 4, False), (5, 6, False), (8, 9, False)]
