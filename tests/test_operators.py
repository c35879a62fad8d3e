import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import sightline.plans  # noqa: F401
from sightline.catalog import ORACLES, QUERIES
from sightline.functions import expressions as X
from sightline.operators import aggregates, equivalence, folds, geometry, graph, islands, joins, matching, scorecard, tracker, windows
from sightline.plans.tracking import CAMERAS
from sightline.sources import jsonl


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_runs_and_gaps(spark):
    df = spark.createDataFrame([("a", t) for t in (1, 2, 2, 5, 9, 10)] + [("b", 4), ("b", None)], "k string, t long")
    assert rows(islands.runs(df, ["k"], "t", 2), "k", "first") == [("a", 1, 5, 3), ("a", 9, 10, 2), ("b", 4, 4, 1)]
    assert rows(islands.gaps(df.filter("k = 'a'"), ["k"], "t", 2), "after") == [("a", 5, 9, 3)]


def test_merging_touches_and_drops(spark):
    df = spark.createDataFrame([(0, 5), (5, 7), (8, 30), (9, 10), (40, 41)], "s long, t long").withColumn("k", F.lit(1))
    assert rows(islands.merge_intervals(df, ["k"], "s", "t"), "start") == [(1, 0, 7, 2), (1, 8, 30, 2), (1, 40, 41, 1)]
    assert rows(islands.merge_intervals(df, ["k"], "s", "t", 1, 10), "start") == [(1, 0, 30, 4)]


def test_merging_is_its_sql_where_times_are_missing_and_intervals_repeat(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(5)
    events = [(i, None if i % 9 == 0 else f"2024-01-0{rng.randint(1, 4)} {rng.randint(0, 23):02d}:10:00", i % 7, "click", float(rng.randint(0, 9))) for i in range(400)]
    events += [(400 + i, t, k, e, v) for i, (_, t, k, e, v) in enumerate(events[:100])] + [(900, None, 8, "click", 1.0), (901, None, 8, "click", 3.0)]
    spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    one = duckdb.connect(config={"threads": 1})  # more threads may order equal intervals differently in the SQL's two windows
    one.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("merge_touching", "merge_then_drop"):
        got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(map(str, got)) == sorted(map(str, one.execute(ORACLES[name]).fetchall())) and len(got) > 5


def test_neutral_rows_keep_a_run(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "x"), (4, "y")], "t long, s string").withColumn("k", F.lit(1))
    assert rows(islands.state_runs(df, ["k"], "t", "s"), "first") == [(1, "x", 1, 3, 2), (1, "y", 4, 4, 1)]
    assert len(rows(islands.state_runs(df, ["k"], "t", "s", neutral=False), "first")) == 4


def test_bounded_fill(spark):
    values = {0: 1.0, 3: 4.0, 12: 2.0}
    df = spark.createDataFrame([(t, values.get(t)) for t in range(18)], "t long, v double").withColumn("k", F.lit(1))
    got = {r.t: r.filled for r in islands.fill_bounded(df, ["k"], "t", "v").collect()}
    assert got[1] == 2.0 and got[2] == 3.0 and got[7] is None and got[15] == 2.0 and got[16] is None


def test_ranks(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,), (None,), (float("nan"),)], "v double").withColumn("k", F.lit(1))
    got = sorted((r.rank for r in windows.average_rank(df, ["k"], "v").collect()), key=str)
    assert got == [1.0, 2.5, 2.5, 4.0, None, None]
    assert windows.normalized_rank(df.filter("v = 5"), ["k"], "v").first()["rank"] == 0.5


@pytest.mark.parametrize("seed", range(3))
def test_interval_and_nearest_joins(spark, seed):
    r = random.Random(seed)
    points = [(i, r.randrange(2), r.randrange(60)) for i in range(50)]
    spans = [(i, r.randrange(2), a, a + r.randrange(1, 20)) for i, a in enumerate(r.randrange(60) for _ in range(25))]
    p = spark.createDataFrame(points, "i long, k long, t long")
    s = spark.createDataFrame(spans, "j long, k long, a long, z long")
    got = {(x.i, x.j) for x in joins.interval_join(p, s, ["k"], "t", "a", "z", 7).collect()}
    assert got == {(i, j) for (i, k, t), (j, m, a, z) in itertools.product(points, spans) if k == m and a <= t < z}
    q = s.select(F.col("j").alias("jj"), "k", F.col("a").alias("b"), F.col("z").alias("y"))
    pairs = [(x.j, x.jj) for x in joins.overlap_join(s, q, ["k"], ("a", "z"), ("b", "y"), 7).collect()]
    assert sorted(pairs) == sorted((j, n) for (j, k, a, z), (n, m, b, y) in itertools.product(spans, spans) if k == m and a < y and b < z)
    right = s.select("k", F.col("a").alias("t")).distinct()
    for x in joins.nearest(p, right, ["k"], "t").collect():
        others = sorted({a for _, k, a, _ in spans if k == x.k}, key=lambda a: (abs(a - x.t), a))
        assert x.nearest_at == (others[0] if others else None)


def test_scorecard_edges(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, False), (0.8, True), (0.1, False), (None, True), (float("nan"), False)], "s double, y boolean").withColumn("k", F.lit(1))
    x = scorecard.auroc(df, ["k"], "s", "y").first()
    assert (x.positives, x.negatives, x.auroc) == (2, 2, 0.875)
    assert scorecard.auroc(df.filter("y"), ["k"], "s", "y").first().auroc is None
    assert scorecard.best_f1(df, ["k"], "s", "y").first().threshold == 0.8
    tie = spark.createDataFrame([(3.0, True), (2.0, False), (1.0, False), (0.5, True)], "s double, y boolean").withColumn("k", F.lit(1))
    assert scorecard.best_f1(tie, ["k"], "s", "y").first().threshold == 3.0


def test_votes_and_switches(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (2, "a", 2.0), (3, None, 1.0), (4, "a", 0.0)], "t long, c string, w double").withColumn("k", F.lit(1))
    assert aggregates.weighted_vote(df.filter("c is not null"), ["k"], "c", "w").first().winner == "a"
    assert aggregates.switches(df, ["k"], ["t"], "c").first().switches == 1
    assert aggregates.plurality(df.filter("t < 3"), ["k"], "c", 0.6).first().winner is None


def test_boxes(spark):
    df = spark.createDataFrame([([0.0, 0.0, 2.0, 2.0], [1.0, 1.0, 3.0, 3.0]), ([0.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0]), (None, [0.0, 0.0, 1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(X.box_iou(F.col("a"), F.col("b"))).collect()] == [1 / 7, 0.0, None]


def test_debounce(spark):
    values = [True, False, True, True, None, True, True, False, False, True, False, False, False]
    df = spark.createDataFrame(list(enumerate(values)), "t long, v boolean").withColumn("k", F.lit(1))
    got = [r.state for r in folds.debounce(df, ["k"], "t", "v").orderBy("t").collect()]
    assert got == [False, False, False, True, None, False, True, True, True, True, True, True, False]


def test_hysteresis_dates_back():
    values = np.array([9, 1, 1, 1, 9, 1, 9, 9, 9, 1], float)
    assert folds.hysteresis(values, 2, 8, 3) == [(1, 5)]
    assert folds.hysteresis(np.array([1.0, 1, 1]), 2, 8, 3) == [(0, 2)]


def test_assignment_is_optimal():
    r = np.random.default_rng(0)
    for n, m in ((1, 1), (3, 5), (6, 4), (5, 5)):
        cost = r.integers(0, 20, (n, m)).astype(float)
        got = sum(cost[p] for p in matching.assignment(cost))
        k = min(n, m)
        best = min(sum(cost[a, b] for a, b in zip(x, y)) for x in itertools.combinations(range(n), k) for y in itertools.permutations(range(m), k))
        assert got == best
    assert matching.idf1(np.array([[3, 1], [0, 4]]))["idf1"] == 14 / 16


def test_paths():
    scores = np.array([[0, 0, 1], [1, 0, 0], [0, 1, 0], [0, 0, 1]], float)
    path = folds.monotonic_path(scores)
    assert (np.diff(path) >= 0).all()
    cost, pairs = folds.drop_dtw(np.array([[0.0, 9], [9, 9], [9, 0]]), 1.0)
    assert (cost, pairs) == (1.0, [(0, 0), (2, 1)])


def test_triangulation_drops_the_outlier():
    cameras = np.array([CAMERAS[v] for v in CAMERAS])
    point = np.array([3.0, -2.0, 5.0])
    seen = np.array([geometry.project(c, point) for c in cameras])
    assert np.allclose(geometry.triangulate(cameras, seen), point)
    more = np.concatenate([cameras, cameras[:1] + np.array([[[0, 0, 0, 900.0], [0, 0, 0, -4000], [0, 0, 0, 7]]])])
    bad = np.concatenate([seen, [geometry.project(more[3], point) + 300]])
    found, kept = geometry.without_outlier(more, bad, 5.0)
    assert kept == [0, 1, 2] and np.allclose(found, point)


def test_clusters_and_equivalence(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (1, 9)], "a long, b long")
    assert rows(graph.clusters(edges, "a", "b"), "node") == [(1, 1), (3, 3), (4, 3), (5, 3), (8, 1), (9, 1)]
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "i long, s string")
    assert equivalence.digest(a).collect() == equivalence.digest(a.orderBy(F.desc("i"))).collect()
    assert rows(equivalence.differences(a, a.limit(2)), "i")[0][-2:] in (("left", 1),)


def test_strict_and_tolerant_scans(spark, tmp_path):
    good, odd = tmp_path / "good.jsonl", tmp_path / "odd.jsonl"
    good.write_text('{"i": 1, "s": "x"}\n\n{"i": 2}\n')
    odd.write_text(json.dumps({"i": 1, "new": 2}) + "\n")
    assert rows(jsonl.strict(spark, str(good), "i long, s string"), "i") == [(1, "x"), (2, None)]
    with pytest.raises(Exception, match="unknown keys: new"):
        jsonl.strict(spark, str(odd), "i long, s string").collect()
    assert rows(jsonl.tolerant(spark, str(odd), "i long, s string"), "i") == [(1, None)]
    assert jsonl.prefiltered(spark, str(good), "i long, s string", '"s"').count() == 1
    assert jsonl.violations(jsonl.tolerant(spark, str(good), "i long, s string"), small=F.col("i") < 2).count() == 1


def seen(frames, places):
    rig = {v: np.array(c) for v, c in CAMERAS.items()}
    return [(1, f, v, kind, *map(float, geometry.project(c, np.array(at(f), float)))) for f in frames for kind, at in places.items() for v, c in rig.items()]


def test_tracker_keeps_loses_and_resumes(spark):
    places = {"cup": lambda f: (f * 0.5, 0, 0), "pen": lambda f: (60, 20 - f * 0.3, 2)}
    hidden = [r for r in seen(range(40), places) if not (r[3] == "pen" and 10 <= r[1] < 20)]
    df = spark.createDataFrame(hidden, "trial long, frame long, view string, object_class string, u double, v double")
    out = tracker.track(df, "trial", CAMERAS).toPandas()
    assert set(out[out.object_class == "cup"].track_id) == {"cup-1"}
    pens = out[out.object_class == "pen"]
    assert set(pens.track_id) == {"pen-2"} and set(pens[pens.frame == 15].state) == {"coasting"} and set(pens[pens.frame == 21].state) == {"observed"}
    gone = [r for r in seen(range(60), places) if not (r[3] == "pen" and r[1] >= 10)]
    lost = tracker.track(spark.createDataFrame(gone, df.schema), "trial", CAMERAS).toPandas()
    assert list(lost[lost.state == "lost"].track_id) == ["pen-2"]


def test_tracker_stream_equals_batch(spark, tmp_path):
    places = {"cup": lambda f: (f * 0.5, 0, 0), "pen": lambda f: (60, 20 - f * 0.3, 2)}
    schema = "trial long, frame long, view string, object_class string, u double, v double"
    every = seen(range(30), places)
    late = sorted(every, key=lambda r: r[1] + (3 if r[2] == "left" else 0))
    for i in range(3):
        part = late[i * len(late) // 3 : (i + 1) * len(late) // 3]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = tracker.track_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), "trial", CAMERAS, late=60)
    q = stream.writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("tracked").count() == 0  # all wait within the allowed lateness
    stream = tracker.track_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")), "trial", CAMERAS, late=5)
    q = stream.writeStream.format("memory").queryName("tracked2").outputMode("append").option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.processAllAvailable()
    q.stop()
    batch = tracker.track(spark.createDataFrame(every, schema), "trial", CAMERAS).filter("frame < 24")
    assert sorted(map(tuple, spark.table("tracked2").collect())) == sorted(map(tuple, batch.collect()))


def test_greedy_by_chunks_is_greedy_with_ties(monkeypatch):
    monkeypatch.setattr(matching, "CELLS", 900)
    r = np.random.default_rng(4)
    for n, m, values in ((150, 90, 12), (80, 200, 4000), (120, 120, 1)):
        left, right = (np.c_[x, np.zeros(k), x + 10.0, np.full(k, 5.0)] for k, x in ((k, r.integers(0, values, k) / 16) for k in (n, m)))
        for least in (0.3, 0.95, 0.0):
            assert set(matching.greedy_boxes(left, right, least)) == set(matching.greedy(1 - matching.iou(left, right), 1 - least))


def test_tracklets_in_pieces_are_those_of_the_whole_key(spark):
    r = random.Random(3)
    boxes = []
    for key in ("a", None):
        for frame in range(30):
            for _ in range(r.randrange(14) if frame % 11 < 8 else 0):
                x, wide = r.choice([0, 4, 30, 75]) + r.randrange(6) * 0.5, r.choice([8.0, 10.0, 60.0]) if key else 10.0
                boxes.append((key, frame, x, 0.0, x + wide, r.choice([10.0, 12.0])))
    boxes += [("a", 3, None, 0.0, 5.0, 5.0), ("a", 4, 7.0, 0.0, 7.0, 5.0), ("a", 5, 1.0, 0.0, float("inf"), 5.0), ("a", None, 1.0, 0.0, 2.0, 5.0)]

    def link(rows, least=0.3, max_gap=5):
        """A whole key in one place: frame by frame, boxes go greedily to the live tracklet that they overlap most."""
        live, made, out = {}, 0, []
        for frame in sorted({x[0] for x in rows}):
            now = sorted((x[1:] for x in rows if x[0] == frame), key=lambda x: [math.inf if v is None else v for v in x])
            live = {k: x for k, x in live.items() if frame - x[0] <= max_gap + 1}
            told = {}
            if live:
                overlap = matching.iou(np.array([x[1] for x in live.values()], float), np.array(now, float))
                told = {c: list(live)[k] for k, c in matching.greedy(1 - overlap, 1 - least)}
            for i, box in enumerate(now):
                if i not in told:
                    told[i], made = made, made + 1
                live[told[i]] = (frame, box)
                out.append((frame, *box, told[i]))
        return out

    got = [tuple(x) for x in matching.tracklets(spark.createDataFrame(boxes, "k string, frame long, x1 double, y1 double, x2 double, y2 double"), ["k"]).collect()]
    want = [(key, *x) for key in ("a", None) for x in link([b[1:] for b in boxes if b[0] == key and b[1] is not None])] + [("a", None, 1.0, 0.0, 2.0, 5.0, -1)]
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("accuracy", [10_000, 4])
def test_ranked_quantiles_are_exact_percentiles(spark, monkeypatch, accuracy):
    monkeypatch.setattr(aggregates, "ACCURACY", accuracy)
    monkeypatch.setattr(aggregates, "FEW", accuracy // 100)  # the second time no sketch is broadcast
    r = random.Random(6)
    data = [("a", r.gauss(0, 1)) for _ in range(3000)] + [(None, float(r.randrange(4))) for _ in range(999)] + [("b", 2.5), ("c", None), ("d", 1.0), ("d", 4.0), ("d", None)] + [("e", 10.0 ** r.randrange(300)) for _ in range(500)]
    df = spark.createDataFrame(data, "k string, v double")
    at = {"low": 0.0, "p10": 0.1, "p50": 0.5, "p77": 0.77, "top": 1.0}
    got = rows(aggregates.ranked_quantiles(df, ["k"], "v", **at).select("k", *at, "n"), "k")
    assert got == rows(df.groupBy("k").agg(*aggregates.quantiles("v", **at), F.count("*").alias("n")), "k") and len(got) == 6


def test_ranked_quantiles_open_a_bracket_that_misses(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v"))
    want = rows(df.groupBy("k").agg(*aggregates.quantiles("v", a=0.2, b=0.9), F.count("*").alias("n")), "k")
    for wrong in (-5.0, 400.0, 5000.0):
        monkeypatch.setattr(aggregates.F, "percentile_approx", lambda v, ends, accuracy, wrong=wrong: F.max(F.array(*[F.lit(wrong)] * 4)))
        assert rows(aggregates.ranked_quantiles(df, ["k"], "v", a=0.2, b=0.9).select("k", "a", "b", "n"), "k") == want
