"""Aggregates, ranks, scorecards, vectors and folds over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.catalog import query
from sightline.functions import expressions as X
from sightline.operators import aggregates as A
from sightline.operators import equivalence, evidence, folds, graph, matching, vectors
from sightline.operators import scorecard as S
from sightline.operators import windows as W
from sightline.plans.tables import D, E, events, load, scored


@query("multi_grain_summary", """SELECT l_returnflag, l_linestatus, concat_ws('+', CASE WHEN GROUPING(l_returnflag) = 0 THEN 'l_returnflag' END, CASE WHEN GROUPING(l_linestatus) = 0 THEN 'l_linestatus' END) AS grain,
count(*) AS n, max(l_quantity) AS top, median(l_extendedprice) AS middle FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def multi_grain_summary(spark, sf_dir):
    return A.multi_grain(load(spark, sf_dir, "lineitem"), [["l_returnflag", "l_linestatus"], ["l_returnflag"], []], n=F.count("*"), top=F.max("l_quantity"), middle=F.percentile("l_extendedprice", F.lit(0.5)))


@query("quantile_summary", """SELECT l_returnflag, quantile_cont(l_extendedprice, 0.1) AS p10, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.9) AS p90, count(*) AS n FROM lineitem GROUP BY 1""")
def quantile_summary(spark, sf_dir):
    return A.ranked_quantiles(load(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", p10=0.1, p50=0.5, p90=0.9).select("l_returnflag", "p10", "p50", "p90", "n")


@query("median_of_medians", """SELECT l_returnflag, median(m) AS middle, count(*) AS parts FROM (SELECT l_returnflag, l_partkey, median(l_quantity) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def median_of_medians(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_partkey").agg(F.percentile("l_quantity", F.lit(0.5)).alias("m"))
    return x.groupBy("l_returnflag").agg(F.percentile("m", F.lit(0.5)).alias("middle"), F.count("*").alias("parts"))


@query("clamped_gate", """SELECT l_shipdate::DATE AS day, least(greatest(3 * median(l_quantity), 15.0), 80.0) AS gate FROM lineitem GROUP BY 1 HAVING count(*) >= 10""")
def clamped_gate(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.percentile("l_quantity", F.lit(0.5)).alias("m"), F.count("*").alias("n"))
    return x.filter("n >= 10").select("day", X.clamp(3 * F.col("m"), 15.0, 80.0).alias("gate"))


@query("binned_histogram", f"""WITH {E}, g AS (SELECT frame - lag(frame) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM e), b AS (SELECT CASE WHEN gap < 0 THEN -1 WHEN gap < 1 THEN 0 WHEN gap < 6 THEN 1 WHEN gap < 24 THEN 2 ELSE 3 END AS bin FROM g WHERE gap IS NOT NULL)
SELECT CAST(r AS BIGINT) AS bin, (SELECT count(*) FROM b WHERE b.bin = r) AS n FROM range(4) AS t(r)""")
def binned_histogram(spark, sf_dir):
    gap = F.col("frame") - F.lag("frame").over(Window.partitionBy("user_id").orderBy("event_id"))
    return A.histogram(events(spark, sf_dir).withColumn("gap", gap), "gap", [0.0, 1.0, 6.0, 24.0])


@query("fixed_category_summary", """SELECT u.user_id, t.event_type, (SELECT count(*) FROM events e WHERE e.user_id = u.user_id AND e.event_type = t.event_type) AS n FROM (SELECT DISTINCT user_id FROM events) u, (VALUES ('click'), ('purchase'), ('refund'), ('absent')) t(event_type)""")
def fixed_category_summary(spark, sf_dir):
    return A.fixed_categories(load(spark, sf_dir, "events"), ["user_id"], "event_type", ["click", "purchase", "refund", "absent"])


@query("plurality_tiebreak", """SELECT user_id, event_type AS winner, n, CAST(t AS BIGINT) AS "of" FROM (SELECT user_id, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id) AS t, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM events GROUP BY 1, 2) WHERE k = 1""")
def plurality_tiebreak(spark, sf_dir):
    return A.plurality(load(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("decisive_majority", """SELECT user_id, CASE WHEN n >= 0.25 * t THEN event_type END AS winner, n, CAST(t AS BIGINT) AS "of" FROM (SELECT user_id, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id) AS t, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM events GROUP BY 1, 2) WHERE k = 1""")
def decisive_majority(spark, sf_dir):
    return A.plurality(load(spark, sf_dir, "events"), ["user_id"], "event_type", 0.25)


@query("weighted_vote", """WITH p AS (SELECT user_id, event_type, sum(CAST(floor(abs(value)) AS BIGINT)) AS w FROM events GROUP BY 1, 2), t AS (SELECT user_id, sum(w) AS t, count(*) AS votes FROM p GROUP BY 1)
SELECT user_id, event_type AS winner, w / t AS share, votes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, event_type) AS k FROM p JOIN t USING (user_id) WHERE t > 0) WHERE k = 1""")
def weighted_vote(spark, sf_dir):
    x = load(spark, sf_dir, "events").withColumn("w", F.floor(F.abs("value")))
    some = x.groupBy("user_id").agg(F.sum("w").alias("_all")).filter("_all > 0").select("user_id")
    return A.weighted_vote(x.join(some, "user_id", "left_semi"), ["user_id"], "event_type", "w").drop("entropy")


@query("weighted_vote_entropy", """WITH p AS (SELECT user_id, event_type, sum(CAST(floor(abs(value)) AS BIGINT) + 1) AS w FROM events GROUP BY 1, 2), t AS (SELECT user_id, sum(w) AS t, count(*) AS votes FROM p GROUP BY 1)
SELECT user_id, event_type AS winner, round(w / t, 9) AS share, votes, round(entropy, 9) AS entropy FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, event_type) AS k, sum(-w / t * log2(w / t)) OVER (PARTITION BY user_id) AS entropy FROM p JOIN t USING (user_id)) WHERE k = 1""")
def weighted_vote_entropy(spark, sf_dir):
    x = load(spark, sf_dir, "events").withColumn("w", F.floor(F.abs("value")) + 1)
    return A.weighted_vote(x, ["user_id"], "event_type", "w").withColumns({c: F.round(c, 9) for c in ("share", "entropy")})


@query("id_switch_count", """SELECT user_id, CAST(coalesce(sum(CASE WHEN event_type <> p THEN 1 ELSE 0 END), 0) AS BIGINT) AS switches, count(*) AS seen FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) GROUP BY 1""")
def id_switch_count(spark, sf_dir):
    return A.switches(load(spark, sf_dir, "events"), ["user_id"], ["event_id"], "event_type")


@query("step_stability", f"""WITH {E}, h AS (SELECT event_type, frame, count(*) AS n FROM e GROUP BY 1, 2), s AS (SELECT event_type, CASE WHEN frame - lag(frame) OVER w = 1 THEN abs(n - lag(n) OVER w) / lag(n) OVER w END AS s FROM h WINDOW w AS (PARTITION BY event_type ORDER BY frame))
SELECT event_type, count(s) AS steps, median(s) AS median_step FROM s GROUP BY 1""")
def step_stability(spark, sf_dir):
    h = events(spark, sf_dir).groupBy("event_type", "frame").agg(F.count("*").alias("n"))
    return A.stability(h, ["event_type"], "frame", "n")


@query("contingency_split_merge", """SELECT source, lang, n, CAST(sum(n) OVER (PARTITION BY source) AS BIGINT) AS row_n, CAST(sum(n) OVER (PARTITION BY lang) AS BIGINT) AS column_n FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)""")
def contingency_split_merge(spark, sf_dir):
    return A.contingency(load(spark, sf_dir, "documents"), "source", "lang")


@query("tri_state_rule", """WITH x AS (SELECT user_id, count(*) AS n, max(CASE WHEN event_type = 'purchase' THEN value END) AS top FROM events GROUP BY 1) SELECT user_id, (n >= 60 AND top > 200) AS passed FROM x""")
def tri_state_rule(spark, sf_dir):
    x = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("top"))
    return x.select("user_id", A.tri_state(F.col("n") >= 60, F.col("top") > 200).alias("passed"))


_RANK = "(count(*) OVER (PARTITION BY lang ORDER BY n_chars RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2)"


@query("average_rank", f"SELECT doc_id, {_RANK} AS rank FROM documents")
def average_rank(spark, sf_dir):
    return W.average_rank(load(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("v")), ["lang"], "v").select("doc_id", "rank")


@query("normalized_rank", f"SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY lang) = 1 THEN 0.5 ELSE ({_RANK} - 1) / (count(*) OVER (PARTITION BY lang) - 1) END AS rank FROM documents")
def normalized_rank(spark, sf_dir):
    return W.normalized_rank(load(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("v")), ["lang"], "v").select("doc_id", "rank")


@query("combined_confidence_abstain", f"""WITH r AS (SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY lang) = 1 THEN 0.5 ELSE ({_RANK} - 1) / (count(*) OVER (PARTITION BY lang) - 1) END AS rank FROM documents),
c AS (SELECT r.doc_id, CASE WHEN quality IS NOT NULL THEN (rank + quality) / 2 END AS confidence FROM r LEFT JOIN labels USING (doc_id))
SELECT doc_id, confidence, confidence IS NULL OR confidence <= (SELECT quantile_cont(confidence, 0.1) FROM c) AS abstain FROM c""")
def combined_confidence_abstain(spark, sf_dir):
    x = W.normalized_rank(load(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("v")), ["lang"], "v")
    x = x.join(load(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("quality")), "doc_id", "left")
    return S.combined_confidence(x, ["rank", "quality"]).select("doc_id", "confidence", "abstain")


@query("rolling_median_jump", """SELECT event_id, m AS median, CASE WHEN m > 0 THEN value / m END AS jump FROM (SELECT event_id, value, median(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS m FROM events)""")
def rolling_median_jump(spark, sf_dir):
    x = W.rolling_median(load(spark, sf_dir, "events").select("event_id", "user_id", "value"), ["user_id"], ["event_id"], "value", 15)
    return x.select("event_id", "median", F.when(F.col("median") > 0, F.col("value") / F.col("median")).alias("jump"))


@query("band_breach", """SELECT event_id FROM (SELECT event_id, value, median(value) OVER w AS m, count(*) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) WHERE c >= 30 AND (value < 0.5 * m OR value > 2 * m)""")
def band_breach(spark, sf_dir):
    x = W.rolling_median(load(spark, sf_dir, "events").select("event_id", "user_id", "value"), ["user_id"], ["event_id"], "value", 30, 30)
    return x.filter("value < 0.5 * median OR value > 2 * median").select("event_id")


@query("exact_lag_growth", f"""WITH {E}, h AS (SELECT event_type, frame, count(*) AS n FROM e GROUP BY 1, 2) SELECT a.event_type, a.frame, a.n, CAST(b.n AS DOUBLE) AS lagged, a.n / b.n AS growth FROM h a LEFT JOIN h b ON b.event_type = a.event_type AND b.frame = a.frame - 24""")
def exact_lag_growth(spark, sf_dir):
    h = events(spark, sf_dir).groupBy("event_type", "frame").agg(F.count("*").alias("n"))
    return W.exact_lag(h, ["event_type"], "frame", "n", 24).withColumn("growth", F.col("n") / F.col("lagged")).withColumn("lagged", F.col("lagged").cast("double"))


@query("robust_z", """WITH m AS (SELECT l_returnflag, median(l_quantity) AS m FROM lineitem GROUP BY 1), d AS (SELECT l_returnflag, median(abs(l_quantity - m)) AS d FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1)
SELECT l_orderkey, l_linenumber, CASE WHEN d > 0 THEN 0.6745 * (l_quantity - m) / d END AS z FROM lineitem JOIN m USING (l_returnflag) JOIN d USING (l_returnflag)""")
def robust_z(spark, sf_dir):
    return W.robust_z(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"), ["l_returnflag"], "l_quantity").select("l_orderkey", "l_linenumber", "z")


@query("before_after_median", """SELECT event_id, median(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) - median(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS moved FROM events""")
def before_after_median(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    middle = lambda a, b: F.percentile("value", F.lit(0.5)).over(w.rowsBetween(a, b))
    return load(spark, sf_dir, "events").select("event_id", (middle(1, 5) - middle(-5, -1)).alias("moved"))


@query("dense_start", f"""WITH {E}, h AS (SELECT user_id, frame, count(*) AS n FROM e GROUP BY 1, 2), s AS (SELECT user_id, frame, sum(n) OVER (PARTITION BY user_id ORDER BY frame RANGE BETWEEN CURRENT ROW AND 23 FOLLOWING) AS ahead FROM h) SELECT user_id, min(frame) AS start FROM s WHERE ahead >= 4 GROUP BY 1""")
def dense_start(spark, sf_dir):
    h = events(spark, sf_dir).groupBy("user_id", "frame").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("user_id").orderBy("frame").rangeBetween(0, 23))
    return h.withColumn("ahead", ahead).filter("ahead >= 4").groupBy("user_id").agg(F.min("frame").alias("start"))


@query("mid_rank_percentile", """SELECT doc_id, (count(*) OVER (PARTITION BY lang ORDER BY n_chars RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY lang, n_chars) / 2) / count(*) OVER (PARTITION BY lang) AS percentile FROM documents""")
def mid_rank_percentile(spark, sf_dir):
    x = load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    counts = x.groupBy("lang", "n_chars").agg(F.count("*").alias("c"))
    w = Window.partitionBy("lang")
    counts = counts.withColumn("p", (F.sum("c").over(w.orderBy("n_chars")) - F.col("c") / 2) / F.sum("c").over(w))
    return x.join(counts, ["lang", "n_chars"]).select("doc_id", F.col("p").alias("percentile"))


@query("lag_scan_argmin", f"""WITH {E}, a AS (SELECT frame, count(*) AS n FROM e WHERE event_type = 'click' GROUP BY 1), b AS (SELECT frame, count(*) AS n FROM e WHERE event_type = 'purchase' GROUP BY 1),
c AS (SELECT k.lag, sum(abs(a.n - b.n)) AS cost, count(*) AS pairs FROM (SELECT unnest(range(-12, 13)) AS lag) k, a JOIN b ON b.frame = a.frame + k.lag GROUP BY 1)
SELECT CAST(lag AS BIGINT) AS lag, CAST(cost AS BIGINT) AS cost, pairs FROM c ORDER BY cost / pairs, lag LIMIT 1""")
def lag_scan_argmin(spark, sf_dir):
    h = events(spark, sf_dir).groupBy("event_type", "frame").agg(F.count("*").alias("n"))
    a = h.filter("event_type = 'click'").select("frame", "n", F.explode(F.sequence(F.lit(-12).cast("long"), F.lit(12).cast("long"))).alias("lag"))
    b = h.filter("event_type = 'purchase'").select(F.col("frame").alias("_f"), F.col("n").alias("m"))
    c = a.join(b, F.col("frame") + F.col("lag") == F.col("_f")).groupBy("lag").agg(F.sum(F.abs(F.col("n") - F.col("m"))).alias("cost"), F.count("*").alias("pairs"))
    return c.orderBy(F.col("cost") / F.col("pairs"), "lag").limit(1)


@query("auroc", f"""WITH {D}, r AS (SELECT *, count(*) OVER (PARTITION BY lang ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (count(*) OVER (PARTITION BY lang, score) - 1) / 2 AS r FROM d),
s AS (SELECT lang, count(*) FILTER (truth) AS positives, count(*) FILTER (NOT truth) AS negatives, sum(r) FILTER (truth) AS s FROM r GROUP BY 1)
SELECT lang, positives, negatives, CASE WHEN positives * negatives > 0 THEN (s - positives * (positives + 1) / 2) / (positives * negatives) END AS auroc FROM s""")
def auroc(spark, sf_dir):
    return S.auroc(scored(spark, sf_dir), ["lang"], "score", "truth")


@query("confusion", f"""WITH {D} SELECT lang, count(*) FILTER (score >= 1500 AND truth) AS tp, count(*) FILTER (score >= 1500 AND NOT truth) AS fp, count(*) FILTER (score < 1500 AND truth) AS fn, count(*) FILTER (score < 1500 AND NOT truth) AS tn FROM d GROUP BY 1""")
def confusion(spark, sf_dir):
    return S.confusion(scored(spark, sf_dir), ["lang"], "score", "truth", 1500)


_CURVE = f"""{D}, c AS (SELECT lang, score AS threshold, count(*) FILTER (truth) AS p, count(*) FILTER (NOT truth) AS n FROM d GROUP BY 1, 2),
k AS (SELECT lang, threshold, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp, CAST(sum(p) OVER (PARTITION BY lang) AS BIGINT) AS positives FROM c WINDOW w AS (PARTITION BY lang ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, tp / (tp + fp) AS precision, CASE WHEN positives > 0 THEN tp / positives END AS recall, 2 * tp / (tp + fp + positives) AS f1 FROM k)"""


@query("best_f1", f"WITH {_CURVE} SELECT lang, threshold, tp, fp, positives, precision, recall, f1 FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, threshold DESC) AS i FROM f WHERE positives > 0) WHERE i = 1")
def best_f1(spark, sf_dir):
    return S.best_f1(scored(spark, sf_dir), ["lang"], "score", "truth")


@query("recall_floor", f"WITH {_CURVE} SELECT lang, threshold, tp, fp, positives, precision, recall, f1 FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY threshold DESC) AS i FROM f WHERE recall >= 0.8) WHERE i = 1")
def recall_floor(spark, sf_dir):
    return S.recall_floor(scored(spark, sf_dir), ["lang"], "score", "truth")


@query("leave_one_group_out", f"""WITH {D}, g AS (SELECT DISTINCT lang AS held FROM d), c AS (SELECT held, score AS threshold, count(*) FILTER (truth) AS p, count(*) FILTER (NOT truth) AS n FROM g JOIN d ON d.lang <> held GROUP BY 1, 2),
k AS (SELECT held, threshold, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY held) AS positives FROM c WINDOW w AS (PARTITION BY held ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
b AS (SELECT held, threshold FROM (SELECT *, row_number() OVER (PARTITION BY held ORDER BY 2 * tp / (tp + fp + positives) DESC, threshold DESC) AS i FROM k) WHERE i = 1)
SELECT lang, threshold, count(*) FILTER (score >= threshold AND truth) AS tp, count(*) FILTER (score >= threshold AND NOT truth) AS fp, count(*) FILTER (score < threshold AND truth) AS fn, count(*) FILTER (score < threshold AND NOT truth) AS tn FROM d JOIN b ON held = lang GROUP BY 1, 2""")
def leave_one_group_out(spark, sf_dir):
    return S.leave_one_group_out(scored(spark, sf_dir), "lang", "score", "truth")


@query("rule_grid_search", f"""WITH {D}, t AS (SELECT unnest([500, 1000, 2000, 4000]) AS cut), x AS (SELECT cut, lang, count(*) FILTER (score >= cut AND truth) AS tp, count(*) FILTER (score >= cut) AS found FROM t, d GROUP BY 1, 2) SELECT CAST(cut AS BIGINT) AS cut, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(found) AS BIGINT) AS found, count(*) FILTER (tp > 0) AS groups FROM x GROUP BY 1""")
def rule_grid_search(spark, sf_dir):
    x = scored(spark, sf_dir).withColumn("cut", F.explode(F.array(*(F.lit(c).cast("long") for c in (500, 1000, 2000, 4000)))))
    x = x.groupBy("cut", "lang").agg(F.count(F.when((F.col("score") >= F.col("cut")) & F.col("truth"), 1)).alias("tp"), F.count(F.when(F.col("score") >= F.col("cut"), 1)).alias("found"))
    return x.groupBy("cut").agg(F.sum("tp").alias("tp"), F.sum("found").alias("found"), F.count(F.when(F.col("tp") > 0, 1)).alias("groups"))


@query("two_means_cut", """WITH b AS (SELECT p_brand, count(*) AS n, sum(p_size) AS s, sum(p_size * p_size) AS q FROM part GROUP BY 1), c AS (SELECT p_brand, p_size AS cut, count(*) AS k, sum(p_size) AS t FROM part GROUP BY 1, 2),
d AS (SELECT p_brand, cut, sum(k) OVER w AS k, sum(t) OVER w AS t FROM c WINDOW w AS (PARTITION BY p_brand ORDER BY cut ROWS UNBOUNDED PRECEDING)),
e AS (SELECT p_brand, cut, t * t / k + (s - t) * (s - t) / (n - k) AS gain FROM d JOIN b USING (p_brand) WHERE k < n)
SELECT p_brand, CAST(cut AS INTEGER) AS cut FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY gain DESC, cut) AS i FROM e) WHERE i = 1""")
def two_means_cut(spark, sf_dir):
    w = Window.partitionBy("p_brand")
    c = load(spark, sf_dir, "part").groupBy("p_brand", F.col("p_size").alias("cut")).agg(F.count("*").alias("c"), F.sum("p_size").alias("s"))
    c = c.withColumn("k", F.sum("c").over(w.orderBy("cut"))).withColumn("t", F.sum("s").over(w.orderBy("cut"))).withColumn("n", F.sum("c").over(w)).withColumn("all", F.sum("s").over(w)).filter("k < n")
    gain = F.col("t") * F.col("t") / F.col("k") + (F.col("all") - F.col("t")) * (F.col("all") - F.col("t")) / (F.col("n") - F.col("k"))
    return W.first_of(c.withColumn("gain", gain), ["p_brand"], F.col("gain").desc(), F.col("cut")).select("p_brand", "cut")


@query("cluster_components", """WITH RECURSIVE n AS (SELECT a.p_partkey AS u, b.p_partkey AS v FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey AND abs(a.p_retailprice - b.p_retailprice) < 20),
r(node, reach) AS (SELECT DISTINCT u, u FROM n UNION SELECT r.node, n.v FROM r JOIN n ON n.u = r.reach) SELECT node, min(reach) AS cluster FROM r GROUP BY 1""")
def cluster_components(spark, sf_dir):
    return graph.chains(load(spark, sf_dir, "part"), ["p_brand", "p_size"], "p_retailprice", "p_partkey", 20)


@query("graph_components", """WITH RECURSIVE l AS (SELECT DISTINCT l_partkey * 2 AS u, l_suppkey * 2 + 1 AS v FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'R' AND l_discount = 0.1),
n AS (SELECT u, v FROM l UNION SELECT v, u FROM l), r(node, reach) AS (SELECT DISTINCT u, u FROM n UNION SELECT r.node, n.v FROM r JOIN n ON n.u = r.reach) SELECT CAST(node AS BIGINT) AS node, CAST(min(reach) AS BIGINT) AS cluster FROM r GROUP BY 1""")
def graph_components(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem").filter("l_quantity = 50 AND l_returnflag = 'R' AND l_discount = 0.1")
    return graph.clusters(x.select((F.col("l_partkey") * 2).alias("u"), (F.col("l_suppkey") * 2 + 1).alias("v")), "u", "v")


@query("exemplar_top_match", """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), x AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 20),
s AS (SELECT v.vec_id AS query, x.vec_id AS exemplar, list_cosine_similarity(v.e, x.e) AS similarity FROM v JOIN x ON v.vec_id <> x.vec_id) SELECT query, exemplar, round(similarity, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY similarity DESC, exemplar) = 1""")
def exemplar_top_match(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    exemplars = W.first_of(e, ["label"], F.col("id").asc(), k=20)
    return vectors.top_exemplars(e, exemplars, 1).select("query", "exemplar", F.round("similarity", 6).alias("similarity"))


@query("embedding_delta", """WITH v AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT label, vec_id, round(list_cosine_similarity(lag(e) OVER (PARTITION BY label ORDER BY vec_id), e), 6) AS similarity FROM v""")
def embedding_delta(spark, sf_dir):
    return vectors.deltas(load(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding").withColumn("similarity", F.round("similarity", 6))


@query("tumbling_buckets", """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2""")
def tumbling_buckets(spark, sf_dir):
    x = load(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    return x.select(F.col("w.start").alias("start"), "event_type", "n", "top")


_HOURS = f"{E}, h AS (SELECT user_id, frame, max(value) AS v, row_number() OVER (PARTITION BY user_id ORDER BY frame) AS rn FROM e GROUP BY 1, 2)"


@query("debounce", f"""WITH RECURSIVE {_HOURS}, s(user_id, rn, frame, v, state, t, f) AS (SELECT user_id, rn, frame, v > 100, FALSE, CASE WHEN v > 100 THEN 1 ELSE 0 END, CASE WHEN v <= 100 THEN 1 ELSE 0 END FROM h WHERE rn = 1
UNION ALL SELECT h.user_id, h.rn, h.frame, h.v > 100, CASE WHEN h.v IS NULL THEN FALSE WHEN s.state THEN NOT (h.v <= 100 AND s.f + 1 >= 3) ELSE h.v > 100 AND s.t + 1 >= 2 END, CASE WHEN h.v > 100 THEN s.t + 1 ELSE 0 END, CASE WHEN h.v <= 100 THEN s.f + 1 ELSE 0 END
FROM s JOIN h ON h.user_id = s.user_id AND h.rn = s.rn + 1) SELECT user_id, frame, CASE WHEN v IS NOT NULL THEN state END AS state FROM s""")
def debounce(spark, sf_dir):
    h = events(spark, sf_dir).groupBy("user_id", "frame").agg(F.max("value").alias("v"))
    return folds.debounce(h.withColumn("high", F.col("v") > 100), ["user_id"], "frame", "high")


@query("decayed_log_odds", f"WITH {_HOURS}, l AS (SELECT user_id, max(frame) AS last FROM h GROUP BY 1) SELECT user_id, round(sum(coalesce(v, 0) * pow(0.5, (last - frame) / 24.0)), 6) AS total, last FROM h JOIN l USING (user_id) GROUP BY user_id, last")
def decayed_log_odds(spark, sf_dir):
    h = events(spark, sf_dir).groupBy("user_id", "frame").agg(F.max("value").alias("v"))
    return folds.decayed_sum(h, ["user_id"], "frame", "v", 24.0).withColumn("total", F.round("total", 6))


@query("signed_evidence", f"""WITH RECURSIVE {E}, h AS (SELECT user_id, frame, sum(CASE WHEN event_type = 'click' THEN 1.0 WHEN event_type = 'view' THEN -1.0 ELSE 0.0 END) AS c, row_number() OVER (PARTITION BY user_id ORDER BY frame) AS rn FROM e GROUP BY 1, 2),
s(user_id, rn, frame, lo, sign, episode, own) AS (SELECT user_id, rn, frame, CAST(c AS DOUBLE), CASE WHEN abs(c) > 1.5 THEN CAST(sign(c) AS INTEGER) ELSE 0 END, CAST(0 AS BIGINT), CAST(c AS DOUBLE) FROM h WHERE rn = 1
UNION ALL SELECT h.user_id, h.rn, h.frame, s.lo * pow(0.98, h.frame - s.frame) + h.c, CASE WHEN abs(s.lo * pow(0.98, h.frame - s.frame) + h.c) > CASE WHEN s.sign = 0 THEN 1.5 ELSE 2.5 END THEN CAST(sign(s.lo * pow(0.98, h.frame - s.frame) + h.c) AS INTEGER) ELSE s.sign END,
s.episode + CASE WHEN h.frame - s.frame > 12 THEN 1 ELSE 0 END, CASE WHEN h.frame - s.frame > 12 THEN 0 ELSE s.own END + h.c FROM s JOIN h ON h.user_id = s.user_id AND h.rn = s.rn + 1)
SELECT user_id, frame, round(lo, 6) AS log_odds, sign, round(1 / (1 + exp(-lo)), 6) AS confidence, episode, round(own, 6) AS in_episode FROM s""")
def signed_evidence(spark, sf_dir):
    """Clicks against views of a user, fading by the hour, with a sign that needs more to turn than to be set."""
    x = events(spark, sf_dir).select("user_id", "frame", F.when(F.col("event_type") == "click", 1.0).when(F.col("event_type") == "view", -1.0).otherwise(0.0).alias("c"))
    x = evidence.accumulated(x, ["user_id"], "frame", "c", evidence.Rules(0.98, 1.5, 2.5, 12))
    return x.select("user_id", "frame", F.round("log_odds", 6).alias("log_odds"), "sign", F.round("confidence", 6).alias("confidence"), "episode", F.round("in_episode", 6).alias("in_episode"))


@query("content_digest", """SELECT count(*) AS "rows", CAST(sum(h) AS VARCHAR) AS total, bit_xor(h) AS low FROM (SELECT CAST(('0x' || left(md5(CAST(o_orderkey AS VARCHAR) || '|' || CAST(o_custkey AS VARCHAR) || '|' || o_orderstatus || '|' || o_orderpriority), 12)) AS BIGINT) AS h FROM orders)""")
def content_digest(spark, sf_dir):
    return equivalence.digest(load(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("multiset_diff", """WITH a AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1, 2), b AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1, 2)
SELECT o_custkey, o_orderstatus, CASE WHEN coalesce(a.n, 0) > coalesce(b.n, 0) THEN 'left' ELSE 'right' END AS side, abs(coalesce(a.n, 0) - coalesce(b.n, 0)) AS times FROM a FULL JOIN b USING (o_custkey, o_orderstatus) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def multiset_diff(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return equivalence.differences(o.filter("o_orderpriority <> '1-URGENT'").select("o_custkey", "o_orderstatus"), o.filter("o_orderpriority <> '5-LOW'").select("o_custkey", "o_orderstatus"))


def _sides(spark, sf_dir):
    e = events(spark, sf_dir).filter("event_type IN ('click', 'purchase')")
    return e.select("user_id", F.when(F.col("event_type") == "click", "a").otherwise("b").alias("side"), F.col("event_id").alias("item"), F.col("frame").cast("double").alias("at"))


@query("greedy_match")
def greedy_match(spark, sf_dir):
    return matching.match_groups(_sides(spark, sf_dir), ["user_id"], "side", "item", "at", 48.0)


@query("hungarian_match")
def hungarian_match(spark, sf_dir):
    return matching.match_groups(_sides(spark, sf_dir), ["user_id"], "side", "item", "at", 48.0, optimal=True)


@query("idf1")
def idf1(spark, sf_dir):
    return matching.identity_scores(load(spark, sf_dir, "documents").select("lang", "source", F.pmod(F.xxhash64("doc_id"), F.lit(7)).alias("found")), ["lang"], "source", "found")


_ROWS = "x AS (SELECT user_id, event_id, CAST(value AS DOUBLE) AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)"


@query("hysteresis_events", f"""WITH RECURSIVE {_ROWS}, s(user_id, rn, inside, run, turned) AS (SELECT user_id, rn, FALSE, CASE WHEN v <= 50 THEN 1 ELSE 0 END, FALSE FROM x WHERE rn = 1
UNION ALL SELECT x.user_id, x.rn, CASE WHEN s.run = 1 AND h THEN NOT s.inside ELSE s.inside END, CASE WHEN h AND s.run = 0 THEN 1 ELSE 0 END, s.run = 1 AND h FROM s JOIN x ON x.user_id = s.user_id AND x.rn = s.rn + 1, LATERAL (SELECT coalesce(CASE WHEN s.inside THEN x.v >= 60 ELSE x.v <= 50 END, FALSE) AS h) l),
t AS (SELECT user_id, rn, inside, lead(rn) OVER (PARTITION BY user_id ORDER BY rn) AS leaves FROM s WHERE turned), e AS (SELECT user_id, rn - 1 AS a, coalesce(leaves - 2, (SELECT max(rn) FROM x WHERE x.user_id = t.user_id)) AS b FROM t WHERE inside)
SELECT e.user_id, f.event_id AS first, l.event_id AS last FROM e JOIN x f ON f.user_id = e.user_id AND f.rn = a JOIN x l ON l.user_id = e.user_id AND l.rn = b""")
def hysteresis_events(spark, sf_dir):
    return folds.hysteresis_events(load(spark, sf_dir, "events"), ["user_id"], "event_id", "value", 50.0, 60.0, 2)


@query("one_euro", f"""WITH RECURSIVE {_ROWS}, s(user_id, rn, event_id, v, smoothed, speed) AS (SELECT user_id, rn, event_id, v, v, CAST(0 AS DOUBLE) FROM x WHERE rn = 1
UNION ALL SELECT x.user_id, x.rn, x.event_id, x.v, b.b * x.v + (1 - b.b) * s.smoothed, a.speed FROM s JOIN x ON x.user_id = s.user_id AND x.rn = s.rn + 1, LATERAL (SELECT CAST(x.event_id - s.event_id AS DOUBLE) AS dt) d,
LATERAL (SELECT 2 * pi() * dt / (2 * pi() * dt + 1) * (x.v - s.smoothed) / dt + (1 - 2 * pi() * dt / (2 * pi() * dt + 1)) * s.speed AS speed) a, LATERAL (SELECT 2 * pi() * (1 + 0.007 * abs(a.speed)) * dt / (2 * pi() * (1 + 0.007 * abs(a.speed)) * dt + 1) AS b) b)
SELECT user_id, event_id, v AS value, round(smoothed, 6) AS smoothed FROM s""")
def one_euro(spark, sf_dir):
    return folds.smooth(load(spark, sf_dir, "events"), ["user_id"], "event_id", "value").withColumn("smoothed", F.round("smoothed", 6))


@query("tracklets")
def tracklets(spark, sf_dir):
    e = events(spark, sf_dir)
    x = F.pmod("user_id", F.lit(10)).cast("double") * 20 + F.col("value") % 7
    return matching.tracklets(e.select("event_type", "frame", x.alias("x1"), F.lit(0.0).alias("y1"), (x + 20).alias("x2"), F.lit(10.0).alias("y2")), ["event_type"])
