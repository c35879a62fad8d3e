"""Projections, gates, geometry expressions and reshaping over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.catalog import query
from sightline.functions import expressions as X
from sightline.operators import folds
from sightline.operators import windows as W
from sightline.plans.tables import E, events, load


@query("strided_frames", f"""WITH {E}, b AS (SELECT user_id, min(frame) AS a, max(frame) AS z FROM e GROUP BY 1) SELECT DISTINCT user_id, unnest(list_concat(range(a, z + 1, 50), [z])) AS frame FROM b""")
def strided_frames(spark, sf_dir):
    b = events(spark, sf_dir).groupBy("user_id").agg(F.min("frame").alias("a"), F.max("frame").alias("z"))
    return b.select("user_id", F.explode(X.strided(F.col("a"), F.col("z") - F.col("a") + 1, 50)).alias("frame"))


@query("rejection_reason", """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 5 THEN 'small' WHEN l_discount > 0.08 THEN 'discounted' WHEN l_extendedprice / l_quantity > 1800 THEN 'dear' END AS reason FROM lineitem""")
def rejection_reason(spark, sf_dir):
    reason = X.first_reason(("small", F.col("l_quantity") < 5), ("discounted", F.col("l_discount") > 0.08), ("dear", F.col("l_extendedprice") / F.col("l_quantity") > 1800))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", reason.alias("reason"))


def _boxes(spark, sf_dir):
    size, price = F.col("p_size").cast("double"), F.floor(F.col("p_retailprice") / 10).cast("double")
    other = (F.col("p_partkey") % 50).cast("double")
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", F.array(size, other, size + 20, other + 20).alias("a"), F.array(other, size, other + 30, size + 10).alias("b"), F.array(price, price).alias("point"))


_BOX = """b AS (SELECT p_partkey, p_size::DOUBLE AS s, (p_partkey % 50)::DOUBLE AS o, floor(p_retailprice / 10)::DOUBLE AS p FROM part),
x AS (SELECT *, greatest(least(s + 20, o + 30) - greatest(s, o), 0.0) * greatest(least(o + 20, s + 10) - greatest(o, s), 0.0) AS i FROM b)"""


@query("box_overlap", f"WITH {_BOX} SELECT p_partkey, i / (400.0 + 300.0 - i) AS iou, i / 300.0 AS containment FROM x")
def box_overlap(spark, sf_dir):
    return _boxes(spark, sf_dir).select("p_partkey", X.box_iou(F.col("a"), F.col("b")).alias("iou"), X.box_containment(F.col("a"), F.col("b")).alias("containment"))


@query("box_predicates", f"WITH {_BOX} SELECT p_partkey, s + 10 AS cx, o + 10 AS cy, (s <= 4 OR o <= 4 OR s + 20 >= 60 OR o + 20 >= 60) AS clipped, (p BETWEEN s AND s + 20 AND p BETWEEN o AND o + 20) AS inside FROM x")
def box_predicates(spark, sf_dir):
    a = F.col("a")
    centre = X.box_centre(a)
    return _boxes(spark, sf_dir).select("p_partkey", centre[0].alias("cx"), centre[1].alias("cy"), X.box_clipped(a, F.lit(64.0), F.lit(64.0), 4.0).alias("clipped"), X.inside(F.col("point"), a).alias("inside"))


@query("crop_round_trip", "SELECT p_partkey, p_size::DOUBLE AS x, (p_partkey % 50)::DOUBLE AS y FROM part")
def crop_round_trip(spark, sf_dir):
    crop, scale = F.array(F.lit(8.0), F.lit(16.0)), F.lit(2.0)
    back = X.crop_to_full(X.full_to_crop(F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 50).cast("double")), crop, scale), crop, scale)
    return load(spark, sf_dir, "part").select("p_partkey", back[0].alias("x"), back[1].alias("y"))


@query("path_predicate", "SELECT page_id FROM pages WHERE regexp_replace(url, '^[^:]*://[^/]*', '') LIKE '/en/%'")
def path_predicate(spark, sf_dir):
    path = F.regexp_replace("url", "^[^:]*://[^/]*", "")
    return load(spark, sf_dir, "pages").filter(X.path_matches(path, "/en/**")).select("page_id")


@query("shifted_control", f"""WITH {E}, w AS (SELECT event_id, frame, event_type FROM e WHERE frame BETWEEN 473400 AND 473600) SELECT event_id, CASE WHEN event_type = 'click' THEN frame + 5 ELSE frame END AS frame FROM w""")
def shifted_control(spark, sf_dir):
    w = events(spark, sf_dir).filter("frame BETWEEN 473400 AND 473600").select("event_id", "frame", "event_type")
    return w.select("event_id", F.when(F.col("event_type") == "click", F.col("frame") + 5).otherwise(F.col("frame")).alias("frame"))


@query("fill_flag_for_one_view", f"""WITH {E}, bought AS (SELECT DISTINCT user_id, frame FROM e WHERE event_type = 'purchase') SELECT event_id, CASE WHEN event_type = 'view' THEN b.user_id IS NOT NULL ELSE TRUE END AS valid FROM e LEFT JOIN bought b ON b.user_id = e.user_id AND b.frame = e.frame""")
def fill_flag_for_one_view(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", "frame", "event_type")
    bought = e.filter("event_type = 'purchase'").select("user_id", "frame").distinct().withColumn("hit", F.lit(True))
    return e.join(bought, ["user_id", "frame"], "left").select("event_id", F.when(F.col("event_type") == "view", F.coalesce("hit", F.lit(False))).otherwise(True).alias("valid"))


@query("nested_frame_stream", """SELECT l_orderkey, count(*) AS boxes, string_agg(CAST(l_linenumber AS VARCHAR) || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS stream FROM lineitem GROUP BY 1""")
def nested_frame_stream(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("s"))
    line = F.transform("s", lambda r: F.concat(r["l_linenumber"].cast("string"), F.lit(":"), r["l_returnflag"]))
    return x.select("l_orderkey", F.size("s").cast("long").alias("boxes"), F.array_join(line, ",").alias("stream"))


@query("curve_peak_parabola", f"""WITH {E}, h AS (SELECT event_type, frame, count(*) AS n FROM e GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, frame) AS k FROM h)
SELECT p.event_type, p.frame, p.n, CASE WHEN coalesce(l.n, 0) - 2 * p.n + coalesce(r.n, 0) < 0 THEN (coalesce(l.n, 0) - coalesce(r.n, 0)) / (2 * (coalesce(l.n, 0) - 2 * p.n + coalesce(r.n, 0))) ELSE 0.0 END AS "offset"
FROM p LEFT JOIN h l ON l.event_type = p.event_type AND l.frame = p.frame - 1 LEFT JOIN h r ON r.event_type = p.event_type AND r.frame = p.frame + 1 WHERE k = 1""")
def curve_peak_parabola(spark, sf_dir):
    h = events(spark, sf_dir).groupBy("event_type", "frame").agg(F.count("*").alias("n"))
    x = W.exact_lag(W.exact_lag(h, ["event_type"], "frame", "n", 1, "l"), ["event_type"], "frame", "n", -1, "r")
    l, r = F.coalesce("l", F.lit(0)), F.coalesce("r", F.lit(0))  # noqa: E741
    bend = l - 2 * F.col("n") + r
    peak = W.first_of(x, ["event_type"], F.col("n").desc(), F.col("frame"))
    return peak.select("event_type", "frame", "n", F.when(bend < 0, (l - r) / (2 * bend)).otherwise(0.0).alias("offset"))


@query("peak_sign", """WITH c AS (SELECT user_id, event_id, sum(CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS t FROM events)
SELECT user_id, CAST(sign(t) AS BIGINT) AS side FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(t) DESC, event_id) AS k FROM c) WHERE k = 1""")
def peak_sign(spark, sf_dir):
    step = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", -1).otherwise(0)
    x = load(spark, sf_dir, "events").withColumn("t", F.sum(step).over(Window.partitionBy("user_id").orderBy("event_id")))
    return W.first_of(x, ["user_id"], F.abs("t").desc(), F.col("event_id")).select("user_id", F.signum("t").cast("long").alias("side"))


@query("any_of_windows", f"""WITH {E} SELECT event_id FROM e WHERE (frame >= 473360 AND frame < 473400) OR (frame >= 473500 AND frame < 473520)""")
def any_of_windows(spark, sf_dir):
    spans = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(z).alias("z")) for a, z in ((473360, 473400), (473500, 473520))))
    return events(spark, sf_dir).filter(F.exists(spans, lambda w: (F.col("frame") >= w["a"]) & (F.col("frame") < w["z"]))).select("event_id")


@query("moved_over_window", """SELECT event_id, coalesce(abs(value - lag(value, 4) OVER (PARTITION BY user_id ORDER BY event_id)) >= 30, FALSE) AS moved FROM events""")
def moved_over_window(spark, sf_dir):
    before = F.lag("value", 4).over(Window.partitionBy("user_id").orderBy("event_id"))
    return load(spark, sf_dir, "events").select("event_id", F.coalesce(F.abs(F.col("value") - before) >= 30, F.lit(False)).alias("moved"))


@query("id_fragments", """WITH f AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS identities, max(c) AS together FROM (SELECT l_partkey, l_suppkey, count(*) OVER (PARTITION BY l_partkey, l_orderkey) AS c FROM lineitem) GROUP BY 1) SELECT l_partkey, identities - together AS fragments FROM f WHERE identities > together""")
def id_fragments(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.count("*").over(Window.partitionBy("l_partkey", "l_orderkey")).alias("c"))
    f = x.groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("identities"), F.max("c").alias("together"))
    return f.filter("identities > together").select("l_partkey", (F.col("identities") - F.col("together")).alias("fragments"))


@query("memory_gate")
def memory_gate(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") % 1).alias("score"), F.lit(0.9).alias("overlap"), ((F.col("value") * 7) % 1).alias("contested"), F.col("value").alias("area"))
    return folds.gated(e, ["user_id"], "event_id", "score", "overlap", "contested", "area")
