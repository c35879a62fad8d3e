"""Searches over settings and nested documents, made from lines and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.catalog import query
from sightline.operators import nested, settings
from sightline.plans.tables import load

AXES = {"l_quantity": [1.0, 10.0, 20.0, 30.0, 40.0], "l_discount": [0.0, 0.03, 0.06, 0.09]}
_GRID = """g AS (SELECT q.t AS l_quantity, d.t AS l_discount FROM (SELECT unnest([1.0, 10.0, 20.0, 30.0, 40.0]) AS t) q, (SELECT unnest([0.0, 0.03, 0.06, 0.09]) AS t) d),
c AS (SELECT l_linenumber, CAST(g.l_quantity AS DOUBLE) AS l_quantity, CAST(g.l_discount AS DOUBLE) AS l_discount, count(*) FILTER (l_returnflag = 'R') AS tp, count(*) AS found FROM lineitem l, g WHERE l.l_quantity >= g.l_quantity AND l.l_discount >= g.l_discount GROUP BY ALL),
n AS (SELECT l_linenumber, count(*) FILTER (l_returnflag = 'R') AS positives FROM lineitem GROUP BY 1)"""


def _counts(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"), F.col("l_discount").cast("double").alias("l_discount"), "l_returnflag")
    return settings.grid_counts(x, ["l_linenumber"], F.col("l_returnflag") == "R", AXES)


@query("settings_grid", f"WITH {_GRID} SELECT l_linenumber, l_quantity, l_discount, tp, found, positives FROM c JOIN n USING (l_linenumber)")
def settings_grid(spark, sf_dir):
    """What each pair of thresholds lets through, from one pass over the lines."""
    return _counts(spark, sf_dir)


@query("settings_search", f"""WITH {_GRID}, x AS (SELECT l_linenumber, l_quantity, l_discount, tp, found, positives, sum(tp) OVER w - tp AS ttp, sum(found) OVER w - found AS tfound, sum(positives) OVER w - positives AS tpos FROM c JOIN n USING (l_linenumber) WINDOW w AS (PARTITION BY l_quantity, l_discount)),
r AS (SELECT *, row_number() OVER (PARTITION BY l_linenumber ORDER BY CASE WHEN ttp >= 0.3 * tpos THEN 1 ELSE 0 END DESC, round(ttp / tfound, 6) DESC, tfound DESC, l_quantity, l_discount) AS k FROM x)
SELECT l_linenumber, l_quantity, l_discount, CAST(ttp AS BIGINT) AS train_tp, CAST(tfound AS BIGINT) AS train_found, CAST(tpos AS BIGINT) AS train_positives, tp, found, positives FROM r WHERE k = 1""")
def settings_search(spark, sf_dir):
    """For each line number the thresholds that the other numbers choose: first three tenths of the returned lines found, then precision, then lines."""
    enough = (F.col("tp") >= 0.3 * F.col("positives")).cast("int")
    return settings.chosen_settings(_counts(spark, sf_dir), ["l_linenumber"], list(AXES), [enough, F.round(F.col("tp") / F.col("found"), 6), F.col("found")])


def _documents(spark, sf_dir, run: str):
    """Each order as a nested document; the second run changes what is volatile everywhere, and a price and a list here and there."""
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("double") + F.when((k % 97 == 0) & F.lit(run == "b"), 1.0).otherwise(0.0)
    parts = F.when((k % 89 == 0) & F.lit(run == "b"), F.array(F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("y")))
    body = F.struct(
        F.lit(run).alias("run_id"), F.concat(F.lit(f"runs/{run}/"), k.cast("string")).alias("uri"), F.struct(F.lit(f"t-{run}").alias("made_at"), F.round(price, 2).alias("price"), parts.alias("parts")).alias("detail"),
        F.array(F.struct(F.lit(run).alias("seen_at"), F.col("o_orderstatus").alias("status"))).alias("states"),
    )
    return o.select("o_orderkey", F.parse_json(F.to_json(body)).alias("document"))


VOLATILE = nested.Volatile(keys=("run_id",), suffixes=("_at",), texts=(("runs/[ab]/", "runs/<run>/"),))


@query("nested_differences", """SELECT o_orderkey, '$.detail.price' AS path, 'both' AS side FROM orders WHERE o_orderkey % 97 = 0 UNION ALL SELECT o_orderkey, '$.detail.parts[1]', 'left' FROM orders WHERE o_orderkey % 89 = 0""")
def nested_differences(spark, sf_dir):
    """Where the documents of two runs differ once run names and times are taken out."""
    found = nested.differences(_documents(spark, sf_dir, "a"), _documents(spark, sf_dir, "b"), ["o_orderkey"], "document", VOLATILE)
    return found.select("o_orderkey", "path", "side")


@query("nested_digests", """SELECT o_orderkey, 5 AS leaves, o_orderkey % 97 <> 0 AND o_orderkey % 89 <> 0 AS same FROM orders""")
def nested_digests(spark, sf_dir):
    """Whether the documents of two runs have one digest."""
    a, b = (nested.digests(_documents(spark, sf_dir, r), ["o_orderkey"], "document", VOLATILE) for r in "ab")
    return a.join(b.select("o_orderkey", F.col("digest").alias("other")), "o_orderkey").select("o_orderkey", F.col("leaves").cast("int").alias("leaves"), (F.col("digest") == F.col("other")).alias("same"))
