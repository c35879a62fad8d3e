"""Scans, joins, aggregates and episodes over events and line items."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.catalog import query
from sightline.functions import expressions as X
from sightline.operators import aggregates as A
from sightline.operators import islands as I  # noqa: E741
from sightline.operators import joins as J
from sightline.operators import windows as W
from sightline.plans.tables import E, events, load


@query("episodes_max_gap", f"""WITH {E}, f AS (SELECT DISTINCT user_id, frame FROM e),
g AS (SELECT *, CASE WHEN frame - lag(frame) OVER w > 3 OR lag(frame) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM f WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY frame) AS run FROM g)
SELECT user_id, min(frame) AS first, max(frame) AS last, count(*) AS n FROM r GROUP BY user_id, run""")
def episodes_max_gap(spark, sf_dir):
    return I.runs(events(spark, sf_dir), ["user_id"], "frame", 2)


@query("episodes_consecutive", f"""WITH {E}, f AS (SELECT DISTINCT user_id, event_type, frame FROM e),
r AS (SELECT *, frame - row_number() OVER (PARTITION BY user_id, event_type ORDER BY frame) AS run FROM f)
SELECT user_id, event_type, min(frame) AS first, max(frame) AS last, count(*) AS n FROM r GROUP BY user_id, event_type, run""")
def episodes_consecutive(spark, sf_dir):
    return I.runs(events(spark, sf_dir), ["user_id", "event_type"], "frame", 0)


@query("hour_gaps", f"""WITH {E}, f AS (SELECT DISTINCT user_id, frame FROM e),
g AS (SELECT user_id, lag(frame) OVER (PARTITION BY user_id ORDER BY frame) AS after, frame AS before FROM f)
SELECT user_id, after, before, before - after - 1 AS missing FROM g WHERE before - after - 1 > 12""")
def hour_gaps(spark, sf_dir):
    return I.gaps(events(spark, sf_dir), ["user_id"], "frame", 12)


_IV = f"{E}, iv AS (SELECT user_id, frame AS s, frame + 1 + CAST(floor(value) AS BIGINT) % 5 AS t FROM e WHERE value >= 0)"


def _intervals(spark, sf_dir):
    return events(spark, sf_dir).filter("value >= 0").select("user_id", F.col("frame").alias("s"), (F.col("frame") + 1 + F.floor("value") % 5).alias("t"))


def _merge_sql(gap, shortest=None):
    return f"""WITH {_IV}, m AS (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
r AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT user_id, min(s) AS start, max(t) AS stop, count(*) AS n FROM r GROUP BY user_id, run""" + (f" HAVING max(t) - min(s) >= {shortest}" if shortest else "")


@query("merge_touching", _merge_sql(0))
def merge_touching(spark, sf_dir):
    return I.merge_intervals(_intervals(spark, sf_dir), ["user_id"], "s", "t")


@query("merge_then_drop", _merge_sql(4, 10))
def merge_then_drop(spark, sf_dir):
    return I.merge_intervals(_intervals(spark, sf_dir), ["user_id"], "s", "t", 4, 10)


def _runs_sql(state, keep):
    return f"""WITH {E}, x AS (SELECT user_id, event_id, {state} AS state FROM e), y AS (SELECT * FROM x {keep}),
f AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR state IS DISTINCT FROM lag(state) OVER w THEN 1 ELSE 0 END AS fresh FROM y WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM f)
SELECT user_id, any_value(state) AS state, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r GROUP BY user_id, run"""


@query("neutral_row_runs", _runs_sql("CASE WHEN event_type = 'click' THEN NULL ELSE event_type END", "WHERE state IS NOT NULL"))
def neutral_row_runs(spark, sf_dir):
    return I.state_runs(events(spark, sf_dir), ["user_id"], "event_id", F.when(F.col("event_type") != "click", F.col("event_type")))


@query("support0_outcomes", _runs_sql("event_type", ""))
def support0_outcomes(spark, sf_dir):
    return I.state_runs(events(spark, sf_dir), ["user_id"], "event_id", "event_type", neutral=False)


@query("episodes_with_flags", f"""WITH {E}, h AS (SELECT user_id, frame, count(*) AS n, max(value) AS top, bool_or(event_type = 'purchase') AS bought FROM e GROUP BY user_id, frame),
f AS (SELECT *, CASE WHEN frame - lag(frame) OVER w > 2 OR lag(frame) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM h WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY frame) AS run FROM f)
SELECT user_id, min(frame) AS first, max(frame) AS last, CAST(sum(n) AS BIGINT) AS n, max(top) AS peak, bool_or(bought) AS bought FROM r GROUP BY user_id, run""")
def episodes_with_flags(spark, sf_dir):
    e = events(spark, sf_dir)
    hours = e.groupBy("user_id", "frame").agg(F.count("*").alias("n"), F.max("value").alias("top"), F.bool_or(F.col("event_type") == "purchase").alias("bought"))
    found = I.runs(hours, ["user_id"], "frame", 1).select("user_id", "first", "last")
    joined = J.interval_join(hours, found, ["user_id"], "frame", "first", "last", 24, closed=True)
    return joined.groupBy("user_id", "first", "last").agg(F.sum("n").alias("n"), F.max("top").alias("peak"), F.bool_or("bought").alias("bought"))


@query("stationary_runs", f"""WITH {E}, x AS (SELECT user_id, event_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) < 20 AS still FROM e),
f AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR still IS DISTINCT FROM lag(still) OVER w THEN 1 ELSE 0 END AS fresh FROM x WHERE still IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM f)
SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r WHERE still GROUP BY user_id, run HAVING count(*) >= 2""")
def stationary_runs(spark, sf_dir):
    e = events(spark, sf_dir)
    still = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))) < 20
    found = I.state_runs(e.withColumn("still", still), ["user_id"], "event_id", "still")
    return found.filter("state AND n >= 2").select("user_id", "first", "last", "n")


@query("gap_fill_bounded", f"""WITH {E}, h AS (SELECT user_id, frame, max(value) AS v FROM e GROUP BY 1, 2), b AS (SELECT user_id, min(frame) AS a, max(frame) AS z FROM h GROUP BY 1),
g AS (SELECT user_id, unnest(range(a, z + 3)) AS frame FROM b), x AS (SELECT g.user_id, g.frame, v FROM g LEFT JOIN h USING (user_id, frame)),
y AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN frame END IGNORE NULLS) OVER p AS pt, last_value(v IGNORE NULLS) OVER p AS pv, first_value(CASE WHEN v IS NOT NULL THEN frame END IGNORE NULLS) OVER n AS nt, first_value(v IGNORE NULLS) OVER n AS nv FROM x
 WINDOW p AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, frame, v AS value, CASE WHEN v IS NOT NULL THEN v WHEN pt IS NOT NULL AND nt IS NOT NULL THEN CASE WHEN nt - pt - 1 <= 5 THEN pv + (nv - pv) * (frame - pt) / (nt - pt) END WHEN nt IS NULL AND frame - pt <= 3 THEN pv WHEN pt IS NULL AND nt - frame <= 3 THEN nv END AS filled FROM y""")
def gap_fill_bounded(spark, sf_dir):
    h = events(spark, sf_dir).groupBy("user_id", "frame").agg(F.max("value").alias("value"))
    grid = h.groupBy("user_id").agg(F.min("frame").alias("a"), F.max("frame").alias("z")).select("user_id", F.explode(F.sequence(F.col("a"), F.col("z") + 2)).alias("frame"))
    return I.fill_bounded(grid.join(h, ["user_id", "frame"], "left"), ["user_id"], "frame", "value")


@query("round_robin_rank", """WITH k AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events)
SELECT event_id, event_type, row_number() OVER (ORDER BY k, value DESC, event_id) AS rank FROM k""")
def round_robin_rank(spark, sf_dir):
    return I.round_robin(load(spark, sf_dir, "events"), "event_type", F.col("value").desc(), F.col("event_id")).select("event_id", "event_type", "rank")


@query("scan_rank_slots", """SELECT l_orderkey, l_linenumber, l_returnflag || '#' || CAST(row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_extendedprice DESC, l_linenumber) - 1 AS VARCHAR) AS slot
FROM lineitem WHERE l_quantity >= 10""")
def scan_rank_slots(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem").filter("l_quantity >= 10")
    rank = F.row_number().over(Window.partitionBy("l_orderkey", "l_returnflag").orderBy(F.col("l_extendedprice").desc(), "l_linenumber")) - 1
    return x.select("l_orderkey", "l_linenumber", X.slot_label(F.col("l_returnflag"), rank).alias("slot"))


@query("slot_class_round_trip", """SELECT p_partkey, split_part(p_type || '#' || CAST(p_size AS VARCHAR), '#', 1) AS object_class, regexp_replace(p_brand || '_group', '_group$', '') AS base FROM part""")
def slot_class_round_trip(spark, sf_dir):
    slot = X.slot_label(F.col("p_type"), F.col("p_size"))
    return load(spark, sf_dir, "part").select("p_partkey", X.class_of_slot(slot).alias("object_class"), X.base_class(F.concat("p_brand", F.lit("_group"))).alias("base"))


@query("top_per_key", """SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS k FROM lineitem) WHERE k = 1""")
def top_per_key(spark, sf_dir):
    return W.first_of(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_orderkey"], F.col("l_extendedprice").desc(), F.col("l_linenumber"))


@query("source_precedence", f"""WITH {E}, r AS (SELECT *, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS p FROM e)
SELECT event_id, user_id, frame, event_type FROM (SELECT *, min(p) OVER (PARTITION BY user_id, frame) AS b FROM r) WHERE p = b""")
def source_precedence(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", "frame", "event_type")
    return J.prefer(e, ["user_id", "frame"], "event_type", ["purchase", "click"])


@query("keyed_semi_scan", """SELECT event_id, user_id, event_type, value FROM events WHERE user_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 40)""")
def keyed_semi_scan(spark, sf_dir):
    keys = load(spark, sf_dir, "lineitem").filter("l_quantity >= 40").select(F.col("l_orderkey").alias("user_id"))
    return load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value").join(keys, "user_id", "left_semi")


@query("seed_filter_semi", """SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 5000)""")
def seed_filter_semi(spark, sf_dir):
    seeds = load(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(seeds, "o_custkey", "left_semi")


@query("reject_filter_anti", """SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')""")
def reject_filter_anti(spark, sf_dir):
    rejected = load(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(rejected, "o_custkey", "left_anti")


@query("dense_grid_left_join", f"""WITH {E}, u AS (SELECT DISTINCT user_id FROM e), f AS (SELECT unnest(range((SELECT min(frame) FROM e), (SELECT max(frame) FROM e) + 1, 24)) AS day),
c AS (SELECT user_id, frame // 24 * 24 AS d, count(*) AS n FROM e GROUP BY 1, 2)
SELECT u.user_id, f.day, CAST(c.n AS DOUBLE) AS n FROM u CROSS JOIN f LEFT JOIN c ON c.user_id = u.user_id AND c.d = f.day // 24 * 24""")
def dense_grid_left_join(spark, sf_dir):
    e = events(spark, sf_dir)
    days = e.agg(F.sequence(F.min("frame"), F.max("frame"), F.lit(24).cast("long")).alias("days"))
    grid = e.select("user_id").distinct().join(F.broadcast(days)).select("user_id", F.explode("days").alias("day"))  # days is one row
    counts = e.groupBy("user_id", F.floor(F.col("frame") / 24).alias("_d")).agg(F.count("*").alias("n"))
    return grid.withColumn("_d", F.floor(F.col("day") / 24)).join(counts, ["user_id", "_d"], "left").select("user_id", "day", F.col("n").cast("double").alias("n"))


@query("full_outer_status", f"""WITH {E}, a AS (SELECT DISTINCT user_id, frame FROM e WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id, frame FROM e WHERE event_type = 'purchase')
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.frame, b.frame) AS frame, CASE WHEN a.user_id IS NULL THEN 'right' WHEN b.user_id IS NULL THEN 'left' ELSE 'both' END AS status FROM a FULL JOIN b ON a.user_id = b.user_id AND a.frame = b.frame""")
def full_outer_status(spark, sf_dir):
    e = events(spark, sf_dir)
    return J.full_status(e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'"), ["user_id", "frame"])


@query("paired_delta", """WITH a AS (SELECT l_partkey, max(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey, max(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT l_partkey, a.v AS "left", b.v AS "right", b.v - a.v AS delta FROM a JOIN b USING (l_partkey)""")
def paired_delta(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.max("l_extendedprice").alias("v"))
    return A.paired(x.filter("l_returnflag = 'A'"), x.filter("l_returnflag = 'R'"), ["l_partkey"], "v")


@query("frozen_denominator_coverage", f"""WITH {E}, k AS (SELECT DISTINCT user_id, frame FROM e), h AS (SELECT DISTINCT user_id, frame FROM e WHERE value > 100)
SELECT k.user_id, count(*) AS cells, count(h.user_id) AS hit, count(h.user_id) / count(*) AS coverage FROM k LEFT JOIN h ON h.user_id = k.user_id AND h.frame = k.frame GROUP BY 1""")
def frozen_denominator_coverage(spark, sf_dir):
    cells = events(spark, sf_dir).groupBy("user_id", "frame").agg(F.bool_or(F.col("value") > 100).alias("hit"))
    return cells.groupBy("user_id").agg(F.count("*").alias("cells"), F.count(F.when(F.col("hit"), 1)).alias("hit")).withColumn("coverage", F.col("hit") / F.col("cells"))


@query("star_join_dims", """SELECT r_name, n_name, c_mktsegment, count(*) AS orders, max(o_totalprice) AS top FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL""")
def star_join_dims(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_totalprice").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    x = o.join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.groupBy("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("orders"), F.max("o_totalprice").alias("top"))


_EP = f"""{E}, f AS (SELECT DISTINCT user_id, frame FROM e WHERE event_type = 'view'), g AS (SELECT *, CASE WHEN frame - lag(frame) OVER w > 7 OR lag(frame) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM f WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY frame) AS run FROM g), ep AS (SELECT user_id, min(frame) AS first, max(frame) + 1 AS stop FROM r GROUP BY user_id, run)"""


def _episodes(spark, sf_dir, kind="view"):
    e = events(spark, sf_dir)
    return I.runs(e.filter(F.col("event_type") == kind), ["user_id"], "frame", 6).select("user_id", "first", (F.col("last") + 1).alias("stop"))


@query("point_in_interval", f"""WITH {_EP} SELECT e.event_id, ep.first, ep.stop FROM e JOIN ep ON e.user_id = ep.user_id AND e.frame >= ep.first AND e.frame < ep.stop WHERE e.event_type = 'purchase'""")
def point_in_interval(spark, sf_dir):
    points = events(spark, sf_dir).filter("event_type = 'purchase'").select("event_id", "user_id", "frame")
    return J.interval_join(points, _episodes(spark, sf_dir), ["user_id"], "frame", "first", "stop", 24).select("event_id", "first", "stop")


@query("interval_overlap_join", f"""WITH {_EP}, c AS (SELECT user_id, frame - 2 AS a, frame + 3 AS z, event_id FROM e WHERE event_type = 'purchase')
SELECT event_id, first, stop, least(stop, z) - greatest(first, a) AS shared FROM ep JOIN c ON ep.user_id = c.user_id AND first < z AND a < stop""")
def interval_overlap_join(spark, sf_dir):
    c = events(spark, sf_dir).filter("event_type = 'purchase'").select("user_id", (F.col("frame") - 2).alias("a"), (F.col("frame") + 3).alias("z"), "event_id")
    x = J.overlap_join(_episodes(spark, sf_dir), c, ["user_id"], ("first", "stop"), ("a", "z"), 24)
    return x.select("event_id", "first", "stop", (F.least("stop", "z") - F.greatest("first", "a")).alias("shared"))


@query("last_known_before_gap", f"""WITH {E}, c AS (SELECT DISTINCT user_id, frame FROM e WHERE event_type = 'click'), p AS (SELECT event_id, user_id, frame FROM e WHERE event_type = 'purchase')
SELECT event_id, user_id, p.frame, CAST((SELECT max(c.frame) FROM c WHERE c.user_id = p.user_id AND c.frame <= p.frame) AS DOUBLE) AS matched_at FROM p""")
def last_known_before_gap(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", "frame", "event_type")
    clicks = e.filter("event_type = 'click'").select("user_id", "frame").distinct().withColumn("v", F.lit(1))
    return J.asof(e.filter("event_type = 'purchase'").drop("event_type"), clicks, ["user_id"], "frame", "v").select("event_id", "user_id", "frame", F.col("matched_at").cast("double").alias("matched_at"))


@query("nearest_key_join", f"""WITH {E}, c AS (SELECT DISTINCT user_id, frame FROM e WHERE event_type = 'click'), p AS (SELECT event_id, user_id, frame FROM e WHERE event_type = 'purchase')
SELECT event_id, user_id, p.frame, (SELECT c.frame FROM c WHERE c.user_id = p.user_id ORDER BY abs(c.frame - p.frame), c.frame LIMIT 1) AS nearest_at FROM p""")
def nearest_key_join(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", "frame", "event_type")
    clicks = e.filter("event_type = 'click'").select("user_id", "frame").distinct()
    return J.nearest(e.filter("event_type = 'purchase'").drop("event_type"), clicks, ["user_id"], "frame")


@query("theta_overlap_semi", """WITH x AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity) AS BIGINT) AS a, CAST(floor(l_quantity) AS BIGINT) + 5 AS z, l_returnflag FROM lineitem)
SELECT l_orderkey, l_linenumber FROM x WHERE l_returnflag = 'A' AND EXISTS (SELECT 1 FROM x y WHERE y.l_orderkey = x.l_orderkey AND y.l_returnflag <> 'A' AND y.a < x.z AND x.a < y.z)""")
def theta_overlap_semi(spark, sf_dir):
    low = F.floor("l_quantity")
    x = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", low.alias("a"), (low + 5).alias("z"))
    other = x.filter("l_returnflag <> 'A'").select("l_orderkey", F.col("a").alias("oa"), F.col("z").alias("oz"))
    mine = x.filter("l_returnflag = 'A'")
    return mine.join(other, (mine.l_orderkey == other.l_orderkey) & (other.oa < mine.z) & (mine.a < other.oz), "left_semi").select("l_orderkey", "l_linenumber")


@query("best_overlap_match", """WITH x AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity) AS BIGINT) AS a, CAST(floor(l_quantity) AS BIGINT) + 8 AS z, l_returnflag FROM lineitem),
p AS (SELECT x.l_orderkey, x.l_linenumber, y.l_linenumber AS match, least(x.z, y.z) - greatest(x.a, y.a) AS shared FROM x JOIN x y ON x.l_orderkey = y.l_orderkey AND y.a < x.z AND x.a < y.z WHERE x.l_returnflag = 'A' AND y.l_returnflag <> 'A')
SELECT l_orderkey, l_linenumber, match, shared FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY shared DESC, match) AS k FROM p) WHERE k = 1""")
def best_overlap_match(spark, sf_dir):
    low = F.floor("l_quantity")
    x = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", low.alias("a"), (low + 8).alias("z"))
    other = x.filter("l_returnflag <> 'A'").select("l_orderkey", F.col("l_linenumber").alias("match"), F.col("a").alias("oa"), F.col("z").alias("oz"))
    p = x.filter("l_returnflag = 'A'").join(other, "l_orderkey").filter("oa < z AND a < oz").withColumn("shared", F.least("z", "oz") - F.greatest("a", "oa"))
    return W.first_of(p, ["l_orderkey", "l_linenumber"], F.col("shared").desc(), F.col("match")).select("l_orderkey", "l_linenumber", "match", "shared")


@query("near_duplicate_pairs", """SELECT a.p_partkey AS low, b.p_partkey AS high FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey AND abs(a.p_retailprice - b.p_retailprice) < 5""")
def near_duplicate_pairs(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice", F.floor(F.col("p_retailprice") / 5).alias("bucket"))
    q = p.select(F.col("p_partkey").alias("high"), "p_brand", "p_size", F.col("p_retailprice").alias("price"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    return p.join(q, ["p_brand", "p_size", "bucket"]).filter("p_partkey < high AND abs(p_retailprice - price) < 5").select(F.col("p_partkey").alias("low"), "high")


@query("unordered_pair_metrics", f"""WITH {E}, t AS (SELECT DISTINCT user_id, frame, event_type FROM e)
SELECT a.event_type AS one, b.event_type AS two, count(*) AS together FROM t a JOIN t b ON a.user_id = b.user_id AND a.frame = b.frame AND a.event_type < b.event_type GROUP BY 1, 2""")
def unordered_pair_metrics(spark, sf_dir):
    sets = events(spark, sf_dir).groupBy("user_id", "frame").agg(F.array_sort(F.collect_set("event_type")).alias("s")).filter(F.size("s") > 1)  # as many as there are types
    pairs = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice(F.col("s"), i + 2, F.size("s")), lambda y: F.struct(x.alias("one"), y.alias("two")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.one", "p.two").agg(F.count("*").alias("together"))


@query("two_tier_match", f"""WITH {E}, c AS (SELECT DISTINCT user_id, frame FROM e WHERE event_type = 'click'), p AS (SELECT event_id, user_id, frame FROM e WHERE event_type = 'purchase')
SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.user_id = p.user_id AND c.frame = p.frame) THEN 'exact' WHEN EXISTS (SELECT 1 FROM c WHERE c.user_id = p.user_id AND abs(c.frame - p.frame) <= 6) THEN 'near' ELSE 'none' END AS tier FROM p""")
def two_tier_match(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", "frame", "event_type")
    x = J.nearest(e.filter("event_type = 'purchase'"), e.filter("event_type = 'click'").select("user_id", "frame").distinct(), ["user_id"], "frame")
    away = F.abs(F.col("nearest_at") - F.col("frame"))
    return x.select("event_id", F.when(away == 0, "exact").when(away <= 6, "near").otherwise("none").alias("tier"))


@query("json_payload_project", """SELECT event_id, json_extract_string(props, '$.k') AS k, length(props) AS size FROM events""")
def json_payload_project(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.char_length("props").cast("long").alias("size"))
