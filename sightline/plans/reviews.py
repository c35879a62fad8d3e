"""Review measures over the driver tables: events by hour stand for parts by frame, orders and line items for tracks and arms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.catalog import query
from sightline.functions import expressions as X
from sightline.functions import masks as M
from sightline.operators import aggregates as A
from sightline.operators import reviews as R
from sightline.operators import windows as W
from sightline.plans.tables import D, E, events, load, scored

#: Events by kind and hour: how many (n) and the largest value (v).
_H = f"{E}, h AS (SELECT event_type, frame, count(*) AS n, max(value) AS v FROM e GROUP BY 1, 2)"


def hours(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type", "frame").agg(F.count("*").alias("n"), F.max("value").alias("v"))


def _episodes(source: str, keys: str, threshold: float, gap: int, shortest: int = 1) -> str:
    """DuckDB: the episodes of (keys, frame, score), as score_episodes gives them."""
    return f"""_s AS (SELECT {keys}, frame, max(score) AS score FROM {source} WHERE score >= {threshold} GROUP BY ALL),
_n AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY {keys} ORDER BY frame) <= {gap + 1} THEN 0 ELSE 1 END AS fresh FROM _s),
_r AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM _n)
SELECT {keys}, min(frame) AS start, max(frame) AS stop, arg_max(frame, {{'a': score, 'b': -frame}}) AS peak, max(score) / {threshold} AS score
FROM _r GROUP BY {keys}, run HAVING max(frame) - min(frame) + 1 >= {shortest}"""


@query("score_episodes", f"WITH {_H}, x AS (SELECT event_type, frame, v AS score FROM h), " + _episodes("x", "event_type", 150.0, 2))
def score_episodes(spark, sf_dir):
    return R.score_episodes(hours(spark, sf_dir).withColumn("score", F.col("v")), ["event_type"], "frame", "score", 150.0, 2)


_PAIR = f"{_H}, p AS (SELECT a.frame, a.n AS na, b.n AS nb FROM h a JOIN h b ON a.frame = b.frame WHERE a.event_type = 'click' AND b.event_type = 'purchase')"


def _pair(spark, sf_dir):
    h = hours(spark, sf_dir)
    a = h.filter("event_type = 'click'").select("frame", F.col("n").alias("na"))
    return a.join(h.filter("event_type = 'purchase'").select("frame", F.col("n").alias("nb")), "frame").withColumn("pair", F.lit("click/purchase"))


@query("swap_episodes", f"WITH {_PAIR}, x AS (SELECT 'click/purchase' AS pair, frame, least(na, nb) / greatest(na, nb) AS score FROM p), q AS (" + "WITH " + _episodes("x", "pair", 0.8, 1) + """)
SELECT q.*, CASE WHEN na > nb THEN 'click' WHEN nb > na THEN 'purchase' END AS absorbing FROM q JOIN p ON p.frame = q.peak""")
def swap_episodes(spark, sf_dir):
    x = _pair(spark, sf_dir).withColumn("score", F.least("na", "nb") / F.greatest("na", "nb"))
    absorbing = F.when(F.col("na") > F.col("nb"), "click").when(F.col("nb") > F.col("na"), "purchase")
    at_peak = x.select("pair", F.col("frame").alias("peak"), absorbing.alias("absorbing"))
    return R.score_episodes(x, ["pair"], "frame", "score", 0.8, 1).join(at_peak, ["pair", "peak"])


@query("label_crossing_episodes", f"WITH {_PAIR}, c AS (SELECT frame, sign(na - nb) AS s, lag(sign(na - nb)) OVER (ORDER BY frame) AS b FROM p WHERE na <> nb), x AS (SELECT 'click/purchase' AS pair, frame, 1.0::DOUBLE AS score FROM c WHERE s <> b), " + _episodes("x", "pair", 1.0, 2))
def label_crossing_episodes(spark, sf_dir):
    x = _pair(spark, sf_dir).filter("na <> nb").withColumn("side", F.signum(F.col("na") - F.col("nb")))
    x = x.withColumn("before", F.lag("side").over(Window.partitionBy("pair").orderBy("frame"))).filter("side <> before").withColumn("score", F.lit(1.0))
    return R.score_episodes(x, ["pair"], "frame", "score", 1.0, 2)


_Z = f"""{_H}, m AS (SELECT event_type, median(v) AS m FROM h GROUP BY 1), d AS (SELECT event_type, median(abs(v - m)) AS d FROM h JOIN m USING (event_type) GROUP BY 1),
z AS (SELECT event_type, frame, n, abs(0.6745 * (v - m) / d) AS z FROM h JOIN m USING (event_type) JOIN d USING (event_type) WHERE d > 0)"""


@query("leakage_episodes", f"WITH {_Z}, x AS (SELECT event_type, frame, greatest(1.0, z / 3.0, CASE WHEN event_type IN ('click', 'refund') THEN n / 4.0 ELSE 0.0 END) AS score FROM z WHERE z > 3.0 OR (event_type IN ('click', 'refund') AND n > 4)), " + _episodes("x", "event_type", 1.0, 2))
def leakage_episodes(spark, sf_dir):
    """How far a part's value lies from its own middle, or a dark part's share, whichever is the larger in thresholds."""
    x = W.robust_z(hours(spark, sf_dir), ["event_type"], "v").withColumn("z", F.abs("z"))
    dark = F.when(F.col("event_type").isin("click", "refund"), F.col("n") / 4.0).otherwise(0.0)
    x = x.filter((F.col("z") > 3.0) | (dark > 1.0)).filter("z IS NOT NULL").withColumn("score", F.greatest(F.lit(1.0), F.col("z") / 3.0, dark))
    return R.score_episodes(x, ["event_type"], "frame", "score", 1.0, 2)


@query("growth_episodes", f"""WITH {_H}, g AS (SELECT a.event_type, a.frame, a.n, b.n AS n1, c.n AS n6, EXISTS (SELECT 1 FROM h o WHERE o.event_type = 'signup' AND o.frame = a.frame) AS hand FROM h a
LEFT JOIN h b ON b.event_type = a.event_type AND b.frame = a.frame - 1 LEFT JOIN h c ON c.event_type = a.event_type AND c.frame = a.frame - 6),
x AS (SELECT event_type, CASE WHEN hand THEN 'hand_capture_suspect' ELSE 'unexplained' END AS growth, frame, greatest(coalesce(n / n1, 0.0) / 2.0, coalesce(n / n6, 0.0) / 3.0) AS score FROM g), """ + _episodes("x", "event_type, growth", 1.0, 3))
def growth_episodes(spark, sf_dir):
    """Growth over the step before or over a window, in thresholds, apart by whether a hand was there."""
    h = hours(spark, sf_dir)
    x = W.exact_lag(W.exact_lag(h, ["event_type"], "frame", "n", 1).withColumnRenamed("lagged", "n1"), ["event_type"], "frame", "n", 6)
    hand = h.filter("event_type = 'signup'").select("frame", F.lit(True).alias("hand"))
    x = x.join(hand, "frame", "left").withColumn("growth", F.when(F.col("hand"), "hand_capture_suspect").otherwise("unexplained"))
    score = F.greatest(F.coalesce(F.col("n") / F.col("n1"), F.lit(0.0)) / 2.0, F.coalesce(F.col("n") / F.col("lagged"), F.lit(0.0)) / 3.0)
    return R.score_episodes(x.withColumn("score", score), ["event_type", "growth"], "frame", "score", 1.0, 3)


@query("area_anomaly_episodes", f"""WITH {_H}, m AS (SELECT event_type, median(v) AS m FROM h GROUP BY 1), r AS (SELECT event_type, frame, v / m AS r FROM h JOIN m USING (event_type) WHERE m > 0),
x AS (SELECT event_type, 'enlarged' AS kind, frame, r / 1.5 AS score FROM r UNION ALL SELECT event_type, 'collapsed', frame, 0.7 / greatest(1e-6, r) FROM r), """ + _episodes("x", "event_type, kind", 1.0, 1, 2))
def area_anomaly_episodes(spark, sf_dir):
    h = hours(spark, sf_dir)
    x = h.join(h.groupBy("event_type").agg(F.percentile("v", F.lit(0.5)).alias("m")), "event_type").filter("m > 0").withColumn("r", F.col("v") / F.col("m"))
    both = F.array(F.struct(F.lit("enlarged").alias("kind"), (F.col("r") / 1.5).alias("score")), F.struct(F.lit("collapsed").alias("kind"), (0.7 / F.greatest(F.lit(1e-6), F.col("r"))).alias("score")))
    return R.score_episodes(x.select("event_type", "frame", F.inline(both)), ["event_type", "kind"], "frame", "score", 1.0, 1, 2)


_GAP = f"""{E}, f AS (SELECT DISTINCT user_id, frame FROM e), g AS (SELECT user_id, lag(frame) OVER w + 1 AS start, frame AS stop FROM f WINDOW w AS (PARTITION BY user_id ORDER BY frame)), k AS (SELECT * FROM g WHERE stop - start BETWEEN 1 AND 12)"""


def _gaps(spark, sf_dir):
    f = events(spark, sf_dir).select("user_id", "frame").distinct()
    w = Window.partitionBy("user_id").orderBy("frame")
    return f.select("user_id", (F.lag("frame").over(w) + 1).alias("start"), F.col("frame").alias("stop")).filter("stop - start BETWEEN 1 AND 12")


@query("hand_gap_episodes", f"""WITH {_GAP}, p AS (SELECT frame, count(*) AS n FROM e WHERE event_type = 'signup' GROUP BY 1),
s AS (SELECT user_id, start, stop, frame, n / (n + 1.0) AS share FROM k JOIN p ON frame >= start AND frame < stop WHERE n >= 2)
SELECT user_id, start, stop - 1 AS stop, arg_max(frame, {{'a': share, 'b': -frame}}) AS peak, count(*) / greatest(1, stop - start) + max(share) AS score FROM s GROUP BY user_id, start, stop""")
def hand_gap_episodes(spark, sf_dir):
    """Gaps in which something of another kind suggests that the missing one was there; the step of the strongest sign is the peak."""
    signs = events(spark, sf_dir).filter("event_type = 'signup'").groupBy("frame").agg(F.count("*").alias("n")).filter("n >= 2")
    g = _gaps(spark, sf_dir).withColumn("frame", F.explode(F.sequence("start", F.col("stop") - 1)))
    s = g.join(signs, "frame").withColumn("share", F.col("n") / (F.col("n") + 1.0))
    out = s.groupBy("user_id", "start", "stop").agg(F.max_by("frame", F.struct("share", -F.col("frame"))).alias("peak"), F.count("*").alias("c"), F.max("share").alias("m"))
    return out.select("user_id", "start", (F.col("stop") - 1).alias("stop"), "peak", (F.col("c") / F.greatest(F.lit(1), F.col("stop") - F.col("start")) + F.col("m")).alias("score"))


@query("reentry_jump_episodes", f"""WITH {_GAP}, v AS (SELECT user_id, frame, max(value) AS v FROM e GROUP BY 1, 2)
SELECT k.user_id, k.start, k.stop, abs(b.v - a.v) / 100.0 AS score FROM k JOIN v a ON a.user_id = k.user_id AND a.frame = k.start - 1 JOIN v b ON b.user_id = k.user_id AND b.frame = k.stop WHERE abs(b.v - a.v) >= 100""")
def reentry_jump_episodes(spark, sf_dir):
    v = events(spark, sf_dir).groupBy("user_id", "frame").agg(F.max("value").alias("v"))
    w = Window.partitionBy("user_id").orderBy("frame")
    x = v.select("user_id", (F.lag("frame").over(w) + 1).alias("start"), F.col("frame").alias("stop"), (F.abs(F.col("v") - F.lag("v").over(w)) / 100.0).alias("score"))
    return x.filter("stop - start BETWEEN 1 AND 12 AND score >= 1")


@query("contact_intervals", f"""WITH {_H}, s AS (SELECT event_type, frame, CASE WHEN n >= 3 THEN NULL ELSE v > 60 END AS s FROM h), t AS (SELECT *, frame - row_number() OVER (PARTITION BY event_type ORDER BY frame) AS run FROM s WHERE s),
r AS (SELECT event_type, min(frame) AS start, max(frame) + 1 AS stop FROM t GROUP BY event_type, run)
SELECT r.event_type, start, stop, stop - start AS duration, coalesce(NOT s.s, FALSE) AS closed, stop - start < 5 AS flicker FROM r LEFT JOIN s ON s.event_type = r.event_type AND s.frame = r.stop""")
def contact_intervals(spark, sf_dir):
    state = F.when(F.col("n") < 3, F.col("v") > 60)
    return R.contact_intervals(hours(spark, sf_dir).withColumn("state", state), ["event_type"], "frame", "state")


@query("contact_episodes", f"""WITH {_H}, s AS (SELECT event_type, frame, v > 60 AS s FROM h), t AS (SELECT *, frame - row_number() OVER (PARTITION BY event_type ORDER BY frame) AS run FROM s WHERE s),
r AS (SELECT event_type, min(frame) AS start, max(frame) AS stop FROM t GROUP BY event_type, run), d AS (SELECT *, stop - start + 1 AS k, event_type = 'click' AND start % 24 < 12 AS odd FROM r)
SELECT event_type, 'unexpected' AS kind, start, stop, 1.0 + least(1.0, k / 30.0) AS score FROM d WHERE odd UNION ALL SELECT event_type, 'flicker', start, stop, 1.0 FROM d WHERE k < 5""")
def contact_episodes(spark, sf_dir):
    x = R.contact_intervals(hours(spark, sf_dir).withColumn("state", F.col("v") > 60), ["event_type"], "frame", "state")
    odd = (F.col("event_type") == "click") & (F.col("start") % 24 < 12)
    kinds = F.array_compact(
        F.array(
            F.when(odd, F.struct(F.lit("unexpected").alias("kind"), (1.0 + F.least(F.lit(1.0), F.col("duration") / 30.0)).alias("score"))),
            F.when(F.col("flicker"), F.struct(F.lit("flicker").alias("kind"), F.lit(1.0).alias("score"))),
        )
    )
    return x.select("event_type", "start", (F.col("stop") - 1).alias("stop"), F.inline(kinds))


_JITTER = f"{E}, j AS (SELECT a.event_type, a.frame, a.event_id, min(abs(a.value - b.value)) AS moved FROM e a LEFT JOIN e b ON b.event_type = a.event_type AND b.frame = a.frame - 1 GROUP BY 1, 2, 3)"


def _jitter(spark, sf_dir):
    return R.nearest_previous(events(spark, sf_dir), ["event_type"], "frame", "event_id", "value")


@query("jitter_nearest", f"WITH {_JITTER} SELECT event_type, frame, event_id, moved FROM j")
def jitter_nearest(spark, sf_dir):
    return _jitter(spark, sf_dir)


@query("jitter_median", f"WITH {_JITTER} SELECT event_type, median(moved) AS jitter, count(moved) AS n FROM j GROUP BY 1")
def jitter_median(spark, sf_dir):
    return _jitter(spark, sf_dir).groupBy("event_type").agg(F.percentile("moved", F.lit(0.5)).alias("jitter"), F.count("moved").alias("n"))


_PHASES = "p AS (SELECT 'day' || CAST(k AS VARCHAR) AS phase, a + k * 24 AS start, a + k * 24 + 24 AS stop FROM (SELECT min(frame) AS a FROM e), range(40) AS t(k))"


@query("jitter_by_phase", f"WITH {_JITTER}, {_PHASES} SELECT phase, count(moved) AS samples, quantile_cont(moved, 0.5) AS median, quantile_cont(moved, 0.9) AS p90, avg(moved) AS mean FROM p LEFT JOIN j ON frame >= start AND frame < stop GROUP BY 1")
def jitter_by_phase(spark, sf_dir):
    first = events(spark, sf_dir).agg(F.min("frame").alias("a"))
    phases = first.select("a", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("k")).select(F.concat(F.lit("day"), F.col("k")).alias("phase"), (F.col("a") + F.col("k") * 24).alias("start"), (F.col("a") + F.col("k") * 24 + 24).alias("stop"))
    return R.by_phase(_jitter(spark, sf_dir), phases, "frame", "moved", "phase", "start", "stop", 24)


_AREA = "count(*) FILTER (truth) AS positives, count(*) FILTER (NOT truth) AS negatives, CASE WHEN count(*) FILTER (truth) * count(*) FILTER (NOT truth) > 0 THEN (sum(r) FILTER (truth) - count(*) FILTER (truth) * (count(*) FILTER (truth) + 1) / 2) / (count(*) FILTER (truth) * count(*) FILTER (NOT truth)) END AS auroc"


@query("pooled_scores", f"""WITH {D}, c AS (SELECT score AS t, count(*) FILTER (truth) AS p, count(*) FILTER (NOT truth) AS n FROM d GROUP BY 1), k AS (SELECT t, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pos FROM c WINDOW w AS (ORDER BY t DESC ROWS UNBOUNDED PRECEDING)),
b AS (SELECT t AS threshold FROM k ORDER BY 2 * tp / (tp + fp + pos) DESC, t DESC LIMIT 1), x AS (SELECT TRUE AS per_group, lang, score, truth FROM d UNION ALL SELECT FALSE, NULL, score, truth FROM d),
y AS (SELECT *, count(*) OVER (PARTITION BY per_group, lang ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (count(*) OVER (PARTITION BY per_group, lang, score) - 1) / 2 AS r FROM x)
SELECT per_group, lang, {_AREA}, threshold, count(*) FILTER (score >= threshold AND truth) AS tp, count(*) FILTER (score >= threshold AND NOT truth) AS fp, count(*) FILTER (score < threshold AND truth) AS fn, count(*) FILTER (score < threshold AND NOT truth) AS tn FROM y, b GROUP BY per_group, lang, threshold""")
def pooled_scores(spark, sf_dir):
    return R.pooled_scores(scored(spark, sf_dir), "lang", "score", "truth")


@query("visibility_scores", f"""WITH {D}, x AS (SELECT lang, score, quality = 0 AS hidden FROM d WHERE quality IS NOT NULL), y AS (SELECT *, hidden AS truth, count(*) OVER (PARTITION BY lang ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (count(*) OVER (PARTITION BY lang, score) - 1) / 2 AS r FROM x)
SELECT lang, {_AREA}, avg(score) FILTER (hidden) AS mean_hidden, avg(score) FILTER (NOT hidden) AS mean_visible FROM y GROUP BY 1 HAVING count(*) FILTER (hidden) > 0 AND count(*) FILTER (NOT hidden) > 0""")
def visibility_scores(spark, sf_dir):
    """The same detector against another truth: hidden or visible, not failed or not."""
    x = scored(spark, sf_dir).filter("quality is not null").withColumn("hidden", F.col("quality") == 0)
    area = R.scorecard.auroc(x, ["lang"], "score", "hidden").filter("positives > 0 AND negatives > 0")
    means = x.groupBy("lang").agg(F.avg(F.when(F.col("hidden"), F.col("score"))).alias("mean_hidden"), F.avg(F.when(~F.col("hidden"), F.col("score"))).alias("mean_visible"))
    return area.join(means, "lang")


@query("least_agreement", f"""WITH {E}, x AS (SELECT frame, count(DISTINCT event_type) FILTER (event_type IN ('click', 'purchase')) AS views, count(value) AS "rows", min(value) AS least, arg_min(user_id, {{'a': value, 'b': user_id}}) AS slot FROM e GROUP BY 1) SELECT frame, "rows", least, slot FROM x WHERE views = 2""")
def least_agreement(spark, sf_dir):
    """Frames that all views saw, with their least value and the slot that has it."""
    views = F.size(F.collect_set(F.when(F.col("event_type").isin("click", "purchase"), F.col("event_type"))))
    x = events(spark, sf_dir).groupBy("frame").agg(views.alias("views"), F.count("value").alias("rows"), F.min("value").alias("least"), F.min_by("user_id", F.struct("value", "user_id")).alias("slot"))
    return x.filter("views = 2").drop("views")


_FLAGS = ["A", "N", "R"]


@query("arm_scoreboard", "SELECT l_linestatus, median(l_quantity) AS middle_pooled, " + ", ".join(f"median(l_quantity) FILTER (l_returnflag = '{v}') AS \"middle_{v}\"" for v in _FLAGS) + " FROM lineitem GROUP BY 1")
def arm_scoreboard(spark, sf_dir):
    return R.scoreboard(load(spark, sf_dir, "lineitem"), "l_linestatus", "l_returnflag", _FLAGS, lambda c: F.percentile(F.when(c, F.col("l_quantity")), F.lit(0.5)), "middle")


@query("pooled_decision", """WITH x AS (SELECT o_orderstatus AS arm, median(o_totalprice) AS m, count(*) FILTER (o_totalprice < 1000) AS a, count(*) FILTER (o_orderpriority = '1-URGENT') AS b FROM orders GROUP BY 1)
SELECT c.m - b.m AS delta, c.m - b.m >= 0.02 AS beats, c.a < b.a AND c.b < b.b AS clearly_better, c.m - b.m >= 0.02 OR (c.a < b.a AND c.b < b.b) AS run FROM x c, x b WHERE c.arm = 'F' AND b.arm = 'O'""")
def pooled_decision(spark, sf_dir):
    """One arm against another by the rule that was set before: a margin on the middle, or fewer of every fault."""
    faults = {"a": F.col("o_totalprice") < 1000, "b": F.col("o_orderpriority") == "1-URGENT"}
    each = {arm: F.col("o_orderstatus") == status for arm, status in (("c", "F"), ("b", "O"))}
    one = load(spark, sf_dir, "orders").agg(
        *(F.percentile(F.when(c, F.col("o_totalprice")), F.lit(0.5)).alias(f"m_{arm}") for arm, c in each.items()),
        *(F.count(F.when(c & fault, 1)).alias(f"{name}_{arm}") for arm, c in each.items() for name, fault in faults.items()),
    )
    delta, better = F.col("m_c") - F.col("m_b"), (F.col("a_c") < F.col("a_b")) & (F.col("b_c") < F.col("b_b"))
    return one.select(delta.alias("delta"), (delta >= 0.02).alias("beats"), better.alias("clearly_better"), ((delta >= 0.02) | better).alias("run"))


@query("episode_inventory", """SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS "F", count(*) FILTER (l_linestatus = 'O') AS "O", count(*) FILTER (l_shipdate > '1995-01-01') AS late FROM lineitem GROUP BY 1""")
def episode_inventory(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*(F.count(F.when(F.col("l_linestatus") == s, 1)).alias(s) for s in "FO"), F.count(F.when(F.col("l_shipdate") > F.lit("1995-01-01"), 1)).alias("late"))


@query("track_lifetimes", f"WITH {E} SELECT user_id, min(frame) AS first, max(frame) AS last, max(frame) - min(frame) + 1 AS length, count(DISTINCT frame) AS seen FROM e GROUP BY 1")
def track_lifetimes(spark, sf_dir):
    f = events(spark, sf_dir).select("user_id", "frame").distinct()
    return f.groupBy("user_id").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), (F.max("frame") - F.min("frame") + 1).alias("length"), F.count("*").alias("seen"))


@query("ids_per_class", f"WITH {E} SELECT event_type, count(DISTINCT user_id) AS ids, count(DISTINCT user_id) / ((max(frame) - min(frame) + 1) / 24.0) AS a_day FROM e GROUP BY 1")
def ids_per_class(spark, sf_dir):
    e = events(spark, sf_dir)
    span = e.groupBy("event_type").agg(((F.max("frame") - F.min("frame") + 1) / 24.0).alias("days"))
    ids = e.select("event_type", "user_id").distinct().groupBy("event_type").agg(F.count("*").alias("ids"))
    return ids.join(span, "event_type").select("event_type", "ids", (F.col("ids") / F.col("days")).alias("a_day"))


@query("coverage_cube", """SELECT source, lang, count(*) AS "rows", count(quality) AS answered, count(*) FILTER (quality = 1) AS found, count(*) - count(quality) AS abstained, median(n_chars) FILTER (quality = 1) AS middle FROM documents LEFT JOIN labels USING (doc_id) GROUP BY CUBE (source, lang)""")
def coverage_cube(spark, sf_dir):
    x = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    found = F.col("quality") == 1
    return x.cube("source", "lang").agg(F.count("*").alias("rows"), F.count("quality").alias("answered"), F.count(F.when(found, 1)).alias("found"), F.count(F.when(F.col("quality").isNull(), 1)).alias("abstained"), F.percentile(F.when(found, F.col("n_chars")), F.lit(0.5)).alias("middle"))


@query("gate_fractions", """WITH r AS (SELECT l_returnflag, CASE WHEN l_quantity < 5 THEN 'small' WHEN l_discount > 0.08 THEN 'discounted' ELSE 'ok' END AS reason FROM lineitem) SELECT l_returnflag, reason, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag) AS share FROM r GROUP BY 1, 2""")
def gate_fractions(spark, sf_dir):
    reason = X.first_reason(("small", F.col("l_quantity") < 5), ("discounted", F.col("l_discount") > 0.08), otherwise="ok")
    x = load(spark, sf_dir, "lineitem").groupBy("l_returnflag", reason.alias("reason")).agg(F.count("*").alias("n"))
    return x.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("l_returnflag")))


@query("part_medians", "SELECT p_brand, median(p_size) AS middle, count(*) AS n FROM part GROUP BY 1")
def part_medians(spark, sf_dir):
    return load(spark, sf_dir, "part").groupBy("p_brand").agg(F.percentile("p_size", F.lit(0.5)).alias("middle"), F.count("*").alias("n"))


@query("acceptance_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def acceptance_counts(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("correction_counts", f"""WITH {E}, u AS (SELECT DISTINCT frame FROM e WHERE event_type = 'refund'), d AS (SELECT DISTINCT frame // 24 AS day FROM e), f AS (SELECT day, day * 24 + k AS frame FROM d, range(24) AS t(k))
SELECT day, CAST(sum(CASE WHEN frame IN (SELECT frame FROM u) THEN 1 ELSE 0 END) AS BIGINT) AS marked, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM u WHERE u.frame > f.frame - 6 AND u.frame <= f.frame) THEN 1 ELSE 0 END) AS BIGINT) AS crossing FROM f GROUP BY 1""")
def correction_counts(spark, sf_dir):
    """Steps of a day at which, or at most five steps after which, something was reset."""
    e = events(spark, sf_dir)
    days = e.select(F.floor(F.col("frame") / 24).alias("day")).distinct()
    reset = e.filter("event_type = 'refund'").select("frame").distinct()
    touched = reset.select(F.explode(F.sequence("frame", F.col("frame") + 5)).alias("frame"), F.col("frame").alias("reset"))
    touched = touched.groupBy("frame").agg(F.max(F.col("frame") == F.col("reset")).alias("marked")).groupBy(F.floor(F.col("frame") / 24).alias("day")).agg(F.count(F.when(F.col("marked"), 1)).alias("marked"), F.count("*").alias("crossing"))
    return days.join(touched, "day", "left").select("day", F.coalesce("marked", F.lit(0)).alias("marked"), F.coalesce("crossing", F.lit(0)).alias("crossing"))


@query("histogram_percentile", """WITH c AS (SELECT l_returnflag, CAST(l_quantity AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2), k AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY l_returnflag) AS total FROM c) SELECT l_returnflag, min(bin) AS bin FROM k WHERE upto >= greatest(1, ceil(0.9 * total)) GROUP BY 1""")
def histogram_percentile(spark, sf_dir):
    w = Window.partitionBy("l_returnflag")
    c = load(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.col("l_quantity").cast("int").alias("bin")).agg(F.count("*").alias("n"))
    c = c.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    return c.filter(F.col("upto") >= F.greatest(F.lit(1), F.ceil(0.9 * F.col("total")))).groupBy("l_returnflag").agg(F.min("bin").alias("bin"))


@query("area_against_first", f"WITH {_H} SELECT event_type, frame, abs(ln((v + 1.0) / (first_value(v) OVER (PARTITION BY event_type ORDER BY frame) + 1.0))) AS drift FROM h WHERE v >= 0")
def area_against_first(spark, sf_dir):
    first = F.first("v").over(Window.partitionBy("event_type").orderBy("frame"))
    return hours(spark, sf_dir).filter("v >= 0").select("event_type", "frame", F.abs(F.log((F.col("v") + 1.0) / (first + 1.0))).alias("drift"))


@query("even_subsample", f"""WITH {E}, f AS (SELECT DISTINCT user_id, frame FROM e), x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM f)
SELECT user_id, frame FROM x WHERE n <= 7 OR i IN (SELECT CAST(round_even(k * (n - 1) / 6, 0) AS BIGINT) FROM range(7) AS t(k))""")
def even_subsample(spark, sf_dir):
    return R.evenly(events(spark, sf_dir), ["user_id"], "frame", 7)


@query("even_grid", f"WITH {E}, b AS (SELECT user_id, min(frame) AS a, max(frame) - min(frame) AS span FROM e GROUP BY 1) SELECT user_id, CAST(k AS INTEGER) AS place, a + (k * span + 2) // 5 AS frame FROM b, range(6) AS t(k) WHERE span >= 5")
def even_grid(spark, sf_dir):
    b = events(spark, sf_dir).groupBy("user_id").agg(F.min("frame").alias("a"), (F.max("frame") - F.min("frame")).alias("span")).filter("span >= 5")
    x = b.select("user_id", "a", "span", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("place"))
    return x.select("user_id", "place", (F.col("a") + F.floor((F.col("place") * F.col("span") + 2) / 5)).alias("frame"))


@query("fixed_rate_grid", "SELECT n_nationkey, CAST(k * greatest(round_even(30.0 / (n_nationkey + 1), 0), 1) AS BIGINT) AS frame FROM nation, range(100) AS t(k) WHERE k * greatest(round_even(30.0 / (n_nationkey + 1), 0), 1) < 100")
def fixed_rate_grid(spark, sf_dir):
    stride = F.greatest(F.bround(30.0 / (F.col("n_nationkey") + 1)), F.lit(1)).cast("long")
    return load(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(99).cast("long"), stride)).alias("frame"))


@query("class_families", "SELECT p_partkey, CASE WHEN p_type LIKE '%BRASS' THEN 'group' WHEN contains(p_type, 'PROMO') THEN 'pipette' WHEN contains(p_type, 'TIN') THEN 'tip' WHEN p_type IN ('STANDARD ANODIZED STEEL') THEN 'machine' ELSE 'other' END AS family FROM part")
def class_families(spark, sf_dir):
    t = F.col("p_type")
    family = X.first_reason(("group", t.endswith("BRASS")), ("pipette", t.contains("PROMO")), ("tip", t.contains("TIN")), ("machine", t.isin("STANDARD ANODIZED STEEL")), otherwise="other")
    return load(spark, sf_dir, "part").select("p_partkey", family.alias("family"))


_SPEC = "concat(p_size, '-', p_size + 3, ', ', p_partkey % 10, ':30:7,5,')"


@query("frame_lists", "SELECT p_partkey, CAST(list_sort(list_distinct(list_concat(range(p_size, p_size + 4), list_concat(range(p_partkey % 10, 30, 7), [5])))) AS BIGINT[]) AS frames FROM part")
def frame_lists(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", M.frame_list(F.expr(_SPEC)).alias("frames"))


_MASK = f"""{E}, m AS (SELECT user_id, list(DISTINCT frame % 168) FILTER (event_type = 'click') AS a, list(DISTINCT frame % 168) FILTER (event_type = 'purchase') AS b, list(DISTINCT frame % 168) FILTER (event_type = 'refund') AS c FROM e GROUP BY 1)"""


def _masks(spark, sf_dir):
    """A user's hours of the week with events of a kind, as masks of 7 rows and 24 columns."""
    pixel = F.pmod("frame", F.lit(168))
    e = events(spark, sf_dir)
    made = [F.collect_set(F.when(F.col("event_type") == t, pixel)).alias(n) for n, t in (("a", "click"), ("b", "purchase"), ("c", "refund"))]
    x = e.groupBy("user_id").agg(*made)
    return x.select("user_id", *(F.when(F.size(c) > 0, F.col(c)).alias(c) for c in "abc"))


@query("mask_measures", f"""WITH {_MASK} SELECT user_id, coalesce(len(a), 0) AS area, list_sum(list_transform(a, lambda p: p % 24)) / len(a) + 0.5 AS x, list_sum(list_transform(a, lambda p: p // 24)) / len(a) + 0.5 AS y,
CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS iou,
CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN coalesce(len(list_intersect(a, b)), 0) / len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))) END AS agreement,
CASE WHEN len(a) > 0 THEN coalesce(len(list_intersect(a, b)), 0) / len(a) ELSE 0.0 END AS overlap, CASE WHEN len(a) > 0 THEN len(list_intersect(a, list_concat(coalesce(b, []), coalesce(c, [])))) / len(a) ELSE 0.0 END AS covered FROM m""")
def mask_measures(spark, sf_dir):
    a, b, c = (F.col(x) for x in "abc")
    middle = M.centroid(a, 24, pixel_centre=True)
    some_b = F.coalesce(b, F.array().cast("array<bigint>"))
    return _masks(spark, sf_dir).select(
        "user_id", M.area(a).alias("area"), middle[0].alias("x"), middle[1].alias("y"), M.iou(a, b).alias("iou"), M.agreement(a, b).alias("agreement"), M.overlap(a, some_b).alias("overlap"), M.overlap_union(a, [b, c]).alias("covered")
    )


@query("tip_verdict", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity IS NULL THEN 'too few' WHEN l_quantity < 5 THEN 'too short' WHEN l_tax > 0.07 THEN 'too wide' WHEN l_quantity < 200 * greatest(l_tax, 0.05) THEN 'not elongated' WHEN l_discount > 0.09 THEN 'not attached' END AS verdict FROM lineitem")
def tip_verdict(spark, sf_dir):
    q, wide = F.col("l_quantity"), F.col("l_tax")
    verdict = X.first_reason(("too few", q.isNull()), ("too short", q < 5), ("too wide", wide > 0.07), ("not elongated", q < 200 * F.greatest(wide, F.lit(0.05))), ("not attached", F.col("l_discount") > 0.09))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", verdict.alias("verdict"))


@query("closed_intervals", f"WITH {E}, b AS (SELECT user_id, min(frame) AS a FROM e GROUP BY 1) SELECT user_id, a + 24 * k AS start, a + 24 * k + 5 AS stop FROM b, range(3) AS t(k) WHERE (a + 24 * k) % 48 < 30")
def closed_intervals(spark, sf_dir):
    """Intervals that stand as JSON in one column, those that start inside a window kept."""
    b = events(spark, sf_dir).groupBy("user_id").agg(F.min("frame").alias("a"))
    text = F.to_json(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct((F.col("a") + 24 * k).alias("start"), (F.col("a") + 24 * k + 5).alias("stop"))))
    x = b.select("user_id", text.alias("raw")).select("user_id", F.inline(F.from_json("raw", "array<struct<start:bigint,stop:bigint>>")))
    return x.filter(F.pmod("start", F.lit(48)) < 30)


@query("median_centres", "SELECT l_returnflag, l_linestatus, median(l_quantity) AS x, median(l_discount * 100) AS y FROM lineitem WHERE l_tax >= 0.02 GROUP BY 1, 2 HAVING count(*) >= 10")
def median_centres(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem").filter("l_tax >= 0.02").groupBy("l_returnflag", "l_linestatus")
    x = x.agg(F.percentile("l_quantity", F.lit(0.5)).alias("x"), F.percentile(F.col("l_discount") * 100, F.lit(0.5)).alias("y"), F.count("*").alias("n"))
    return x.filter("n >= 10").drop("n")


#: The weights of a quadratic fitted to five points, at its middle.
_SMOOTH = (-3 / 35, 12 / 35, 17 / 35, 12 / 35, -3 / 35)


@query("local_quadratic", "SELECT event_id, " + " + ".join(f"({c}) * {'value' if i == 2 else f'lag(value, {2 - i}) OVER w' if i < 2 else f'lead(value, {i - 2}) OVER w'}" for i, c in enumerate(_SMOOTH)) + " AS smoothed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def local_quadratic(spark, sf_dir):
    """A quadratic fitted to five rows at each row; null at the two rows of each end."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    terms = [F.lit(c) * (F.col("value") if i == 2 else F.lag("value", 2 - i).over(w)) for i, c in enumerate(_SMOOTH)]
    return load(spark, sf_dir, "events").select("event_id", sum(terms[1:], terms[0]).alias("smoothed"))


@query("box_interpolation", f"""WITH {_H}, b AS (SELECT event_type, frame, [n, v, n + 20.0, v + 30.0] AS box, v / 100 AS score FROM h), x AS (SELECT event_type, frame AS t, box AS a, score AS s, lead(frame) OVER w AS u, lead(box) OVER w AS b, lead(score) OVER w AS z FROM b WINDOW w AS (PARTITION BY event_type ORDER BY frame)),
y AS (SELECT *, unnest(range(t + 1, u)) AS frame FROM x WHERE u - t > 1 AND abs(a[2] - b[2]) < 25), p AS (SELECT *, (frame - t) / (u - t) AS k FROM y)
SELECT event_type, frame, (1 - k) * a[1] + k * b[1] AS x1, (1 - k) * a[2] + k * b[2] AS y1, (1 - k) * a[3] + k * b[3] AS x2, (1 - k) * a[4] + k * b[4] AS y2, (1 - k) * s + k * z AS score FROM p""")
def box_interpolation(spark, sf_dir):
    n = F.col("n").cast("double")
    b = hours(spark, sf_dir).select("event_type", "frame", F.array(n, F.col("v"), n + 20.0, F.col("v") + 30.0).alias("box"), (F.col("v") / 100).alias("score"))
    x = R.between_boxes(b, ["event_type"], "frame", "box", "score", F.abs(F.col("_a")[1] - F.col("_b")[1]) < 25)
    return x.select("event_type", "frame", *(F.col("box")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))), "score")


@query("spread_picks")
def spread_picks(spark, sf_dir):
    return R.pick_spread(events(spark, sf_dir), ["user_id"], "frame", 5, 24)


@query("merged_fragments")
def merged_fragments(spark, sf_dir):
    """Runs of hours as pieces of one object, by where they end and begin."""
    h = hours(spark, sf_dir)
    w = Window.partitionBy("event_type").orderBy("frame")
    h = h.withColumn("run", F.sum(F.coalesce((F.col("frame") - F.lag("frame").over(w) > 1).cast("int"), F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = [(F.min_by("v", "frame"), "a"), (F.max_by("v", "frame"), "z")]
    pieces = h.groupBy("event_type", F.col("run").alias("piece")).agg(F.min("frame").alias("first"), F.max("frame").alias("last"), *(e.alias(n) for e, n in ends))
    boxes = [(F.lit(0.0), "0"), (None, "1"), (F.lit(10.0), "2"), (None, "3")]
    columns = [(F.col(n) + (30.0 if i == "3" else 0.0) if c is None else c).cast("double").alias(f"{n}{i}") for n in "az" for c, i in boxes]
    schema = "event_type string, piece long, first long, last long, object long"

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        return R.merge_fragments(rows, 6, 0.3)[["event_type", "piece", "first", "last", "object"]]

    return pieces.select("event_type", "piece", "first", "last", *columns).groupBy("event_type").applyInPandas(one, schema)


@query("expected_summary", f"""WITH {_H}, s AS (SELECT event_type, frame, v > 60 AS s FROM h), t AS (SELECT *, frame - row_number() OVER (PARTITION BY event_type ORDER BY frame) AS run FROM s WHERE s), r AS (SELECT event_type, count(*) AS k FROM t GROUP BY event_type, run)
SELECT event_type, count(*) AS intervals, count(*) FILTER (k < 5) AS brief, min(k) AS shortest, median(k) AS middle, quantile_cont(k, 0.9) AS p90, max(k) AS longest FROM r GROUP BY 1""")
def expected_summary(spark, sf_dir):
    x = R.contact_intervals(hours(spark, sf_dir).withColumn("state", F.col("v") > 60), ["event_type"], "frame", "state")
    return x.groupBy("event_type").agg(F.count("*").alias("intervals"), F.count(F.when(F.col("flicker"), 1)).alias("brief"), F.min("duration").alias("shortest"), *A.quantiles("duration", middle=0.5, p90=0.9), F.max("duration").alias("longest"))
