"""Geometry, scores, clocks and measures along tracks over the driver tables: users stand for tracks, hours for frames, embeddings for points."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.catalog import query
from sightline.functions import expressions as X
from sightline.functions import shapes as S
from sightline.operators import motion, scorecard
from sightline.operators import series as R
from sightline.operators import windows as W
from sightline.plans.tables import D, E, events, load, scored

_V = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def _points(spark, sf_dir, *names: str):
    """Consecutive triples of an embedding's values as points."""
    x = load(spark, sf_dir, "embeddings").withColumn("e", F.transform("embedding", lambda v: v.cast("double")))
    return x.select("vec_id", "e", *(F.slice("e", 3 * i + 1, 3).alias(n) for i, n in enumerate(names)))


def _dot(a: str, b: str) -> str:
    return f"({a}[1] * {b}[1] + {a}[2] * {b}[2] + {a}[3] * {b}[3])"


def _each(f) -> str:
    return "[" + ", ".join(f(i) for i in (1, 2, 3)) + "]"


def _unit(a: str) -> str:
    return _each(lambda i: f"{a}[{i}] / sqrt{_dot(a, a)}")


def _sub(a: str, b: str) -> str:
    return _each(lambda i: f"{a}[{i}] - {b}[{i}]")


@query("line_measures", f"""WITH {_V}, a AS (SELECT vec_id, e[1:3] AS p, e[4:6] AS a, e[7:9] AS q, e[10:12] AS b FROM v), u AS (SELECT vec_id, p, q, {_unit('a')} AS u, {_unit('b')} AS w FROM a),
d AS (SELECT *, {_sub('q', 'p')} AS m FROM u), o AS (SELECT *, {_each(lambda i: f'm[{i}] - u[{i}] * {_dot("m", "u")}')} AS x, {_each(lambda i: f'm[{i}] - w[{i}] * {_dot("m", "w")}')} AS y FROM d)
SELECT vec_id, round(degrees(acos(least(1.0, abs({_dot('u', 'w')})))), 6) AS degrees, round((sqrt{_dot('x', 'x')} + sqrt{_dot('y', 'y')}) / 2, 6) AS apart, round(sqrt{_dot('m', 'm')}, 6) AS middles FROM o""")
def line_measures(spark, sf_dir):
    """Two lines by midpoint and direction: their angle, how far apart they lie and how far their middles."""
    x = _points(spark, sf_dir, "p", "a", "q", "b").select("vec_id", S.line_distance(F.col("p"), S.unit(F.col("a")), F.col("q"), S.unit(F.col("b"))).alias("m"))
    return x.select("vec_id", *(F.round(F.col("m")[c], 6).alias(c) for c in ("degrees", "apart", "middles")))


@query("plane_and_ray", f"""WITH {_V}, a AS (SELECT vec_id, e[1:3] AS p, e[4:6] AS a, e[7:9] AS o FROM v), u AS (SELECT *, {_unit('a')} AS n FROM a), r AS (SELECT *, {_sub('p', 'o')} AS m FROM u)
SELECT vec_id, round({_dot('n', 'p')} - 0.05, 6) AS above, round(o[1] + n[1] * {_dot('m', 'n')}, 6) AS x, round(o[2] + n[2] * {_dot('m', 'n')}, 6) AS y, round(o[3] + n[3] * {_dot('m', 'n')}, 6) AS z FROM r""")
def plane_and_ray(spark, sf_dir):
    """Height above a plane and the closest point of a ray."""
    n = S.unit(F.col("a"))
    x = _points(spark, sf_dir, "p", "a", "o").select("vec_id", F.round(S.above_plane(F.col("p"), n, F.lit(0.05)), 6).alias("above"), S.on_ray(F.col("o"), n, F.col("p")).alias("r"))
    return x.select("vec_id", "above", *(F.round(F.col("r")[i], 6).alias(c) for i, c in enumerate("xyz")))


@query("segment_measures", f"""WITH {_V}, a AS (SELECT vec_id, e[1:3] AS a, e[4:6] AS t, e[7:9] AS o FROM v), x AS (SELECT vec_id, {_sub('t', 'o')} AS x, {_sub('a', 't')} AS f FROM a),
u AS (SELECT *, {_unit('x')} AS u FROM x), l AS (SELECT *, {_dot('f', 'u')} AS l FROM u), r AS (SELECT *, {_each(lambda i: 'f[%d] - l * u[%d]' % (i, i))} AS r FROM l)
SELECT vec_id, round(l, 6) AS along, round(sqrt{_dot('r', 'r')}, 6) AS across, round(degrees(acos({_dot('f', 'x')} / (sqrt{_dot('f', 'f')} * sqrt{_dot('x', 'x')}))), 6) AS degrees FROM r""")
def segment_measures(spark, sf_dir):
    """A point along and across a segment's axis, and the angle between them."""
    a, t, o = (F.col(c) for c in "ato")
    x = _points(spark, sf_dir, "a", "t", "o").select("vec_id", S.along_across(a, t, o).alias("m"), S.angle(S.minus(a, t), S.minus(t, o)).alias("d"))
    return x.select("vec_id", F.round("m.along", 6).alias("along"), F.round("m.across", 6).alias("across"), F.round("d", 6).alias("degrees"))


#: A fixed convex polygon and box around the middle of the embeddings' values.
_POLYGON = ((-0.15, -0.1), (0.1, -0.15), (0.15, 0.1), (-0.1, 0.15))
_SIDES = [f"({b[0] - a[0]!r} * (e[2] - ({a[1]!r})) - ({b[1] - a[1]!r}) * (e[1] - ({a[0]!r})))" for a, b in zip(_POLYGON, _POLYGON[1:] + _POLYGON[:1])]


@query("regions_of_points", f"""WITH {_V} SELECT vec_id, ({' AND '.join(f'{s} >= -1e-9' for s in _SIDES)}) OR ({' AND '.join(f'{s} <= 1e-9' for s in _SIDES)}) AS inside,
round(sqrt(pow(greatest(-0.1 - e[1], 0, e[1] - 0.05), 2) + pow(greatest(-0.05 - e[2], 0, e[2] - 0.1), 2)), 6) AS distance FROM v""")
def regions_of_points(spark, sf_dir):
    point = F.slice("e", 1, 2)
    polygon = F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in _POLYGON))
    box = F.array(*(F.lit(x) for x in (-0.1, -0.05, 0.05, 0.1)))
    return _points(spark, sf_dir).select("vec_id", S.inside_convex(point, polygon).alias("inside"), F.round(S.to_box(point, box), 6).alias("distance"))


@query("clamped_intervals", """WITH x AS (SELECT l_orderkey, l_linenumber, l_tax * 100 AS low, l_tax * 100 + l_quantity AS high, l_suppkey % 4 AS a, l_partkey % 4 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN high - low <= 20 OR a > b THEN low WHEN b > a THEN high - 20 ELSE (low + high) * 0.5 - 10 END AS low,
CASE WHEN high - low <= 20 OR b > a THEN high WHEN a > b THEN low + 20 ELSE (low + high) * 0.5 + 10 END AS high, high - low > 20 AS cut FROM x""")
def clamped_intervals(spark, sf_dir):
    low = F.col("l_tax") * 100
    cut = S.clamped_interval(low, low + F.col("l_quantity"), F.col("l_suppkey") % 4, F.col("l_partkey") % 4, 20.0)
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cut.alias("c")).select("l_orderkey", "l_linenumber", "c.*")


@query("fused_scores", f"""WITH {_V}, s AS (SELECT vec_id, e, greatest(0, 1.0 - abs(e[20]) / 0.1) AS contact, CASE WHEN vec_id % 60 < 20 THEN -0.12 WHEN e[21] >= 0.01 THEN 0.08 ELSE -0.05 END AS prior FROM v)
SELECT vec_id, k AS place, round(e[k + 1] + e[22] * 0.3 + contact * 0.2 + CASE WHEN k BETWEEN 6 AND 9 THEN prior ELSE 0 END, 6) AS score FROM s, range(12) AS r(k)""")
def fused_scores(spark, sf_dir):
    """Scores by label with motion and contact added, and a prior over some labels that depends on the phase."""
    e = F.col("e")
    prior = F.when(F.col("vec_id") % 60 < 20, -0.12).when(e[20] >= 0.01, 0.08).otherwise(-0.05)
    scores = S.fused(F.slice("e", 1, 12), (e[21], 0.3), (S.contact_ramp(F.abs(e[19]), 0.1), 0.2))
    return _points(spark, sf_dir).select("vec_id", F.posexplode(S.conditioned(scores, 6, 10, prior)).alias("place", "score")).select("vec_id", F.col("place").cast("long").alias("place"), F.round("score", 6).alias("score"))


@query("cue_log_odds", f"""WITH {E}, c AS (SELECT user_id, frame // 24 AS day, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM e GROUP BY ALL)
SELECT user_id, day, round(sum(7.0 * least(greatest(value / 100, 0), 1) * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END), 6) AS log_odds, count(*) AS cues FROM c GROUP BY 1, 2""")
def cue_log_odds(spark, sf_dir):
    """The last vote of each cue counts; positive: the first end."""
    c = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("frame") / 24).alias("day"), "event_type").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("event_id"))
    vote = 7.0 * X.clamp(F.col("value") / 100, 0.0, 1.0) * F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(-1.0)
    return c.groupBy("user_id", "day").agg(F.round(F.sum(vote), 6).alias("log_odds"), F.count("*").alias("cues"))


@query("view_names", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'C' || p_size || 'A' WHEN 1 THEN 'HMC_' || p_partkey ELSE '' END AS view,
CASE WHEN p_partkey % 5 = 0 THEN 'a/' || p_partkey ELSE '/other/' || p_partkey END AS path, CASE WHEN p_size > 10 THEN 1.5 + 2.0 * ((p_size - 11) / 30.0) END AS second,
CASE WHEN p_size > 7 AND p_size <> 20 THEN [0.5, 7.0, CAST(p_size AS DOUBLE)] END AS seconds FROM part""")
def view_names(spark, sf_dir):
    """View names, paths, source seconds and lists of seconds read from text."""
    p, n = F.col("p_partkey"), F.col("p_size")
    view = F.when(p % 3 == 0, F.concat(F.lit("static-c"), n, F.lit("a"))).when(p % 3 == 1, F.concat(F.lit("ego-hmc"), p)).otherwise("none")
    path = F.concat(F.when(p % 5 == 0, "/root/of/a/").otherwise("/other/"), p)
    text = F.concat(F.lit(" 0.5, 7,,"), n, F.when(n == 20, ",x").otherwise(", "))
    return load(spark, sf_dir, "part").select(
        "p_partkey", S.view_of(view).alias("view"), S.relative_to(path, "/root/of").alias("path"), S.source_seconds(n - 11, 30.0, 1.5, 2.0).alias("second"), S.seconds_of(text).alias("seconds")
    )


_FIT = R.fit_weights(7, 3)


def _fit(place: int) -> str:
    return " + ".join(f"({float(_FIT[place][j])!r}) * coalesce(lag(value, {place - j}) OVER w, 0)" if place >= j else f"({float(_FIT[place][j])!r}) * coalesce(lead(value, {j - place}) OVER w, 0)" for j in range(7))


@query("local_cubic", f"""SELECT event_id, round(CASE WHEN n >= 7 AND i < 3 THEN [a0, a1, a2][i + 1] WHEN n >= 7 AND n - 1 - i < 3 THEN [z0, z1, z2][n - i] ELSE m END, 6) AS smoothed FROM (
SELECT event_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, {_fit(3)} AS m, {', '.join(f'{_fit(k)} AS a{k}, {_fit(6 - k)} AS z{k}' for k in range(3))}
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))""")
def local_cubic(spark, sf_dir):
    """A cubic fitted to seven rows; the rows at both ends take the fit of the outermost seven."""
    x = R.local_fit(load(spark, sf_dir, "events"), ["user_id"], "event_id", "value", 7, 3)
    return x.select("event_id", F.round("smoothed", 6).alias("smoothed"))


_U = f"{E}, u AS (SELECT user_id, frame, count(*) AS n, max(value) AS v, min(value) AS low, arg_max(event_type, event_id) AS kind FROM e GROUP BY 1, 2)"


def _users(spark, sf_dir):
    """Users by hour: events (n), largest and smallest value (v, low) and the last event's type (kind)."""
    return events(spark, sf_dir).groupBy("user_id", "frame").agg(F.count("*").alias("n"), F.max("value").alias("v"), F.min("value").alias("low"), F.max_by("event_type", "event_id").alias("kind"))


_STATE = "CASE kind WHEN 'click' THEN true WHEN 'purchase' THEN false END"


@query("state_flips", f"""WITH {_U}, s AS (SELECT user_id, frame, {_STATE} AS state, v > 60 AS held, v % 10 < 3 AS ra, v % 10 >= 8 AS rb, low < 8 AS t FROM u),
p AS (SELECT *, last_value(state IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
max(CASE WHEN held THEN frame END) OVER (PARTITION BY user_id ORDER BY frame) AS h, row_number() OVER (PARTITION BY user_id ORDER BY frame) AS i FROM s),
f AS (SELECT *, CASE WHEN frame - h <= 15 THEN h ELSE frame END AS centre FROM p WHERE state AND NOT coalesce(before, false) OR NOT state AND coalesce(before, false)),
o AS (SELECT f.user_id, f.frame, f.state, f.before, count(*) FILTER (x.ra) AS na, count(*) FILTER (x.rb) AS nb, min(x.frame) FILTER (x.ra) AS fa, min(x.frame) FILTER (x.rb) AS fb, count(*) FILTER (x.ra OR x.rb) AS m, min(x.frame) FILTER (x.ra OR x.rb) AS first
FROM f JOIN p x ON x.user_id = f.user_id AND x.i BETWEEN f.i - 15 AND f.i WHERE f.state GROUP BY ALL),
z AS (SELECT f.user_id, f.frame, f.before, count(*) FILTER (x.t) AS m, min(x.frame) FILTER (x.t) AS first FROM f JOIN p x ON x.user_id = f.user_id AND x.frame BETWEEN f.centre - 15 AND f.centre + 15 WHERE NOT f.state GROUP BY ALL)
SELECT user_id, frame, 'on' AS kind, before, CASE WHEN m = 0 THEN NULL WHEN na > nb OR na = nb AND fa <= fb THEN 'rack a' ELSE 'rack b' END AS target, nullif(m, 0) AS frames, first FROM o
UNION ALL SELECT user_id, frame, 'off', before, CASE WHEN m > 0 THEN 'trash' END, nullif(m, 0), first FROM z""")
def state_flips(spark, sf_dir):
    """Where a state turns on near one of two racks or off near the trash."""
    state = F.when(F.col("kind") == "click", True).when(F.col("kind") == "purchase", False)
    u = _users(spark, sf_dir).withColumn("state", state).withColumn("held", F.col("v") > 60)
    racks = {"rack a": F.col("v") % 10 < 3, "rack b": F.col("v") % 10 >= 8}
    return R.flips(u, ["user_id"], "frame", "state", "held", racks, {"trash": F.col("low") < 8})


@query("majority_onsets", f"""WITH {_U}, b AS (SELECT user_id, frame, row_number() OVER (PARTITION BY user_id ORDER BY frame) - 1 AS pos, v, n, v > 55 AS bad FROM u),
s AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS run FROM b WHERE bad), r AS (SELECT user_id, min(pos) AS a, max(pos) + 1 AS z FROM s GROUP BY user_id, run HAVING count(*) >= 2),
l AS (SELECT *, lag(z) OVER (PARTITION BY user_id ORDER BY a) AS lz FROM r), m AS (SELECT *, sum(CASE WHEN a - lz <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS g FROM l),
j AS (SELECT user_id, min(a) AS start, max(z) AS stop, count(*) AS episodes FROM m GROUP BY user_id, g HAVING max(z) - min(a) >= 3)
SELECT user_id, start, stop, episodes, arg_min(v, pos) AS error, max(v) AS worst, arg_min(n, pos) AS agreeing,
CASE WHEN start < 1 THEN 'the first frame is the seed' WHEN arg_min(n, pos) < 2 THEN arg_min(n, pos) || ' agree, 2 required' END AS reason
FROM j JOIN b USING (user_id) WHERE pos >= start AND pos < stop GROUP BY user_id, start, stop, episodes""")
def majority_onsets(spark, sf_dir):
    """Runs of large errors by their onset, with what stands against a correction there."""
    b = _users(spark, sf_dir).withColumn("at", F.row_number().over(Window.partitionBy("user_id").orderBy("frame")).cast("long") - 1)
    return R.onsets(b, ["user_id"], "at", F.col("v") > 55, "v", "n", 2, 1, 3, 2)


@query("moving_frames", f"""WITH {E}, t AS (SELECT event_type, user_id % 3 AS view, frame, arg_max(event_id % 40, {{'v': value, 'i': event_id}}) AS x, max(value) AS y FROM e GROUP BY ALL),
s AS (SELECT b.event_type, b.view, b.frame, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) > 30 AS far FROM t a JOIN t b ON a.event_type = b.event_type AND a.view = b.view AND a.frame = b.frame - 1)
SELECT event_type, frame, list(view ORDER BY view) FILTER (far) AS views FROM s GROUP BY 1, 2 HAVING count(*) FILTER (far) >= 1 AND count(*) FILTER (far) >= least(2, count(*))""")
def moving_frames(spark, sf_dir):
    """Steps at which two views, or all that saw both, find a thing moved."""
    top = events(spark, sf_dir).groupBy("event_type", (F.col("user_id") % 3).alias("view"), "frame").agg(F.max_by(F.col("event_id") % 40, F.struct("value", "event_id")).cast("double").alias("x"), F.max("value").alias("y"))
    return R.moved(top, ["event_type"], "view", "frame", F.array("x", "y"), F.lit(30.0))


@query("dilated_frames", f"WITH {E} SELECT DISTINCT user_id, frame + d AS frame FROM e, range(-3, 4) AS r(d) WHERE value > 60 AND frame + d >= 473362 AND frame + d < 473752")
def dilated_frames(spark, sf_dir):
    return R.dilated(events(spark, sf_dir).filter("value > 60"), ["user_id"], "frame", 3, 473362, 473752)


@query("label_boundaries", f"WITH {_U}, b AS (SELECT user_id, frame, kind, lag(kind) OVER (PARTITION BY user_id ORDER BY frame) AS before, row_number() OVER (PARTITION BY user_id ORDER BY frame) AS i FROM u) SELECT user_id, frame, before, kind FROM b WHERE i > 1 AND before IS DISTINCT FROM kind")
def label_boundaries(spark, sf_dir):
    return R.boundaries(_users(spark, sf_dir), ["user_id"], "frame", "kind")


@query("frames_by_label", f"WITH {_U} SELECT user_id, kind, list(frame ORDER BY frame) AS frames, min(frame) AS first, max(frame) + 1 AS stop FROM u GROUP BY 1, 2")
def frames_by_label(spark, sf_dir):
    return _users(spark, sf_dir).groupBy("user_id", "kind").agg(F.array_sort(F.collect_list("frame")).alias("frames"), F.min("frame").alias("first"), (F.max("frame") + 1).alias("stop"))


@query("method_agreement", f"""WITH {E}, m AS (SELECT user_id, frame // 24 AS day, event_type, max(value) > 20 AS present, max(value) AS x FROM e GROUP BY 1, 2, 3)
SELECT a.event_type AS a, b.event_type AS b, count(*) AS answered, avg((a.present = b.present)::INT) AS presence, count(*) FILTER (a.present AND b.present) AS found,
avg((abs(a.x - b.x) <= 25)::INT) FILTER (a.present AND b.present) AS near, median(abs(a.x - b.x)) FILTER (a.present AND b.present) AS gap
FROM m a JOIN m b ON a.user_id = b.user_id AND a.day = b.day AND a.event_type < b.event_type GROUP BY 1, 2""")
def method_agreement(spark, sf_dir):
    m = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("frame") / 24).alias("day"), "event_type").agg((F.max("value") > 20).alias("present"), F.max("value").alias("x"))
    return R.method_agreement(m, ["user_id", "day"], "event_type", "present", "x", 25.0)


@query("method_consistency", """SELECT event_type, count(*) AS frames, count(*) FILTER (value > 20) AS voted, median(value) FILTER (value > 20) AS middle, quantile_cont(value, 0.1) FILTER (value > 20) AS p10,
quantile_cont(value, 0.9) FILTER (value > 20) AS p90, count(*) FILTER (value BETWEEN 30 AND 70) / nullif(count(*) FILTER (value > 20), 0) AS in_range FROM events GROUP BY 1""")
def method_consistency(spark, sf_dir):
    voted = F.when(F.col("value") > 20, F.col("value"))
    at = {"middle": 0.5, "p10": 0.1, "p90": 0.9}
    in_range = F.try_divide(F.count(F.when(F.col("value").between(30, 70), 1)), F.count(voted))
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("frames"), F.count(voted).alias("voted"), *(F.percentile(voted, F.lit(q)).alias(n) for n, q in at.items()), in_range.alias("in_range"))


@query("mean_histograms", f"WITH {_V}, h AS (SELECT v.vec_id, label, list_transform(e[1:8], lambda x: floor(abs(x) * 100)) AS h FROM v JOIN embeddings USING (vec_id)), b AS (SELECT label, k AS bin, h[k + 1] / list_sum(h) AS share FROM h, range(8) AS r(k) WHERE list_sum(h) > 0) SELECT label, bin, round(avg(share), 9) AS share FROM b GROUP BY 1, 2")
def mean_histograms(spark, sf_dir):
    counts = F.transform(F.slice("embedding", 1, 8), lambda x: F.floor(F.abs(x.cast("double")) * 100).cast("double"))
    x = R.mean_histogram(load(spark, sf_dir, "embeddings").withColumn("h", counts), ["label"], "h")
    return x.select("label", F.col("bin").cast("long").alias("bin"), F.round("share", 9).alias("share"))


@query("single_instances", """WITH x AS (SELECT *, event_type IN ('refund', 'error') AS lone FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY lone, CASE WHEN NOT lone THEN event_id END, event_type, ts ORDER BY value DESC, event_id) AS k FROM
(SELECT event_id, event_type, user_id, value, lone, date_trunc('hour', ts) AS ts FROM x)) SELECT event_id, event_type, CASE WHEN NOT lone THEN user_id END AS object, value FROM k WHERE k = 1""")
def single_instances(spark, sf_dir):
    """Classes of which there is one thing: its best row of each step."""
    x = R.one_per_step(events(spark, sf_dir), ["event_type"], "frame", "user_id", ["refund", "error"], F.desc("value"), F.col("event_id"))
    return x.select("event_id", "event_type", "object", "value")


_AUC = f"""WITH {D}, r AS (SELECT source, lang, truth, rank() OVER (PARTITION BY source, lang ORDER BY score) + (count(*) OVER (PARTITION BY source, lang, score) - 1) / 2.0 AS r FROM d),
a AS (SELECT source, lang, (sum(r) FILTER (truth) - count(*) FILTER (truth) * (count(*) FILTER (truth) + 1) / 2.0) / (count(*) FILTER (truth) * count(*) FILTER (NOT truth)) AS auroc FROM r GROUP BY 1, 2 HAVING count(*) FILTER (truth) > 0 AND count(*) FILTER (NOT truth) > 0)"""


@query("best_detectors", f"{_AUC}, m AS (SELECT source, round(avg(auroc), 9) AS auroc, count(*) AS records FROM a GROUP BY 1) SELECT * FROM m ORDER BY auroc DESC, source LIMIT 3")
def best_detectors(spark, sf_dir):
    """The three detectors of the largest mean AUROC, by name among equals; those without one are left out."""
    a = scorecard.auroc(scored(spark, sf_dir), ["source", "lang"], "score", "truth").filter("auroc IS NOT NULL")
    return a.groupBy("source").agg(F.round(F.avg("auroc"), 9).alias("auroc"), F.count("*").alias("records")).orderBy(F.desc("auroc"), "source").limit(3)


@query("frame_proposals", f"""WITH {_U}, f AS (SELECT u.* FROM u WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.user_id = u.user_id AND x.frame = u.frame AND x.event_type = 'signup')),
a AS (SELECT user_id, frame, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, frame) AS k FROM f), b AS (SELECT user_id, frame, row_number() OVER (PARTITION BY user_id ORDER BY md5('7:' || user_id || ':' || frame), frame) AS k FROM a WHERE k > 4)
SELECT user_id, frame, 'suspect' AS why FROM a WHERE k <= 4 UNION ALL SELECT user_id, frame, 'drawn' FROM b WHERE k <= 2""")
def frame_proposals(spark, sf_dir):
    """The most suspect steps of each user that aren't labelled yet, and a seeded draw of the others."""
    known = events(spark, sf_dir).filter("event_type = 'signup'").select("user_id", "frame").distinct()
    free = _users(spark, sf_dir).join(known, ["user_id", "frame"], "left_anti")
    top = W.first_of(free, ["user_id"], F.desc("v"), F.col("frame"), k=4).select("user_id", "frame", F.lit("suspect").alias("why"))
    rest = free.join(top.select("user_id", "frame"), ["user_id", "frame"], "left_anti")
    drawn = W.first_of(rest, ["user_id"], F.md5(F.concat_ws(":", F.lit("7"), "user_id", "frame").cast("binary")), F.col("frame"), k=2)
    return top.unionByName(drawn.select("user_id", "frame", F.lit("drawn").alias("why")))


@query("tracks_by_slot", f"WITH {_U}, s AS (SELECT DISTINCT user_id, frame, event_type FROM e) SELECT frame, event_type AS view, user_id % 5 AS slot, min(user_id) AS track, count(*) AS tracks FROM s GROUP BY 1, 2, 3")
def tracks_by_slot(spark, sf_dir):
    """Which track a slot of a view supports, from each track's map of views to slots; of several the first, with their number."""
    maps = events(spark, sf_dir).select("user_id", "frame", "event_type").distinct().groupBy("user_id", "frame").agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.col("user_id") % 5))).alias("slots"))
    x = maps.select("user_id", "frame", F.explode("slots").alias("view", "slot"))
    return x.groupBy("frame", "view", "slot").agg(F.min("user_id").alias("track"), F.count("*").alias("tracks"))


@query("padded_cycles", f"""WITH {E}, i AS (SELECT user_id, greatest(frame - 2, 473360) AS a, least(frame + 1 + 2, 473900) AS z FROM e WHERE event_type = 'purchase'), k AS (SELECT DISTINCT * FROM i WHERE a < z),
g AS (SELECT *, sum(CASE WHEN a <= lz THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, max(z) OVER (PARTITION BY user_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lz FROM k))
SELECT user_id, min(a) AS start, max(z) AS stop FROM g GROUP BY user_id, g""")
def padded_cycles(spark, sf_dir):
    x = events(spark, sf_dir).filter("event_type = 'purchase'").withColumn("stop", F.col("frame") + 1)
    return R.padded(x, ["user_id"], "frame", "stop", 2, 473360, 473900).drop("n")


def _boxes(spark, sf_dir):
    """Users' hours as boxes of one class: as wide as the events are many, as high as the values reach."""
    u = _users(spark, sf_dir)
    return u.select((F.col("user_id") % 4).alias("cls"), "user_id", (F.col("frame") % 24).alias("hour"), "frame", "n", "v").groupBy("cls", "user_id", "hour").agg(F.sum("n").alias("n"), F.max("v").alias("v"))


@query("nested_duplicates")
def nested_duplicates(spark, sf_dir):
    holds = ((F.col("_a.n") >= F.col("_b.n")) & (F.col("_a.v") >= F.col("_b.v"))) | ((F.col("_a.n") <= F.col("_b.n")) & (F.col("_a.v") <= F.col("_b.v")))
    return R.nested(_boxes(spark, sf_dir), ["cls"], "user_id", "hour", holds, often=0.6)


@query("nearest_in_order")
def nearest_in_order(spark, sf_dir):
    x = events(spark, sf_dir).filter("event_type IN ('click', 'purchase')").withColumn("left_side", F.col("event_type") == "click")
    return R.nearest_in_order(x.withColumn("point", F.array("value", (F.col("user_id") % 50).cast("double"))), ["frame"], "left_side", "event_id", "point")


@query("ensemble_choices")
def ensemble_choices(spark, sf_dir):
    """A primary and a fallback mask for each user and day, hours of the day as pixels."""
    pixel, day = F.col("frame") % 24, F.floor(F.col("frame") / 24)
    masks = [F.array_sort(F.collect_set(F.when(c, pixel))).alias(n) for n, c in (("primary", F.col("value") < 60), ("fallback", F.col("value") < 90), ("other", F.col("event_type") == "refund"))]
    x = events(spark, sf_dir).groupBy((F.col("user_id") % 8).alias("target"), day.alias("frame")).agg(*masks)
    x = x.select("target", "frame", "primary", "fallback", F.array("other").alias("others"), (F.col("frame") % 11 == 0).alias("hidden"), (F.col("frame") % 3 > 0).alias("inside"))
    return R.ensemble_choices(x, ["target"], 6, window=10, samples=3)


@query("view_motion", """WITH v AS (SELECT label, vec_id // 40 AS frame, min_by(embedding, vec_id) AS e FROM embeddings GROUP BY 1, 2), c AS (SELECT label, frame, i, CAST(e[i + 1] AS DOUBLE) * 100 AS x, CAST(e[i + 6] AS DOUBLE) * 100 AS y FROM v, range(5) r(i)),
f AS (SELECT label, frame, lag(frame) OVER (PARTITION BY label ORDER BY frame) AS before FROM v), s AS (SELECT f.label, f.frame, coalesce(median(a.x - b.x), 0) AS dx, coalesce(median(a.y - b.y), 0) AS dy FROM f LEFT JOIN c a ON a.label = f.label AND a.frame = f.frame
LEFT JOIN c b ON b.label = f.label AND b.frame = f.before AND b.i = a.i GROUP BY 1, 2) SELECT label, frame, round(sum(dx) OVER w, 4) AS dx, round(sum(dy) OVER w, 4) AS dy FROM s WINDOW w AS (PARTITION BY label ORDER BY frame)""")
def view_motion(spark, sf_dir):
    """How far a view has shifted since its first frame, from five centres a frame: too few for an affine map, so each step is their median shift."""
    x = load(spark, sf_dir, "embeddings").groupBy("label", F.floor(F.col("vec_id") / 40).alias("frame")).agg(F.min_by("embedding", "vec_id").alias("e"))
    x = x.select("label", "frame", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("item"), "e")
    x = x.select("label", "frame", "item", (F.get("e", F.col("item")).cast("double") * 100).alias("x"), (F.get("e", F.col("item") + 5).cast("double") * 100).alias("y"))
    wholes = motion.composed(motion.step_maps(x, ["label"], "frame", "item", "x", "y"), ["label"], "frame", block=8)
    return wholes.select("label", "frame", F.round(F.col("whole")[2], 4).alias("dx"), F.round(F.col("whole")[5], 4).alias("dy"))
