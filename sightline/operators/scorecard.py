"""Detector scorecards: confusion, AUROC, thresholds and leave-one-out folds. A row counts if its score and truth are known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.operators.windows import average_rank


def known(df: DataFrame, score: str, truth: str) -> DataFrame:
    return df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(truth).isNotNull())


def auroc(df: DataFrame, keys: list[str], score: str, truth: str) -> DataFrame:
    """keys, positives, negatives, auroc by average ranks; null if a class is empty."""
    x = average_rank(known(df, score, truth).withColumn(score, F.col(score).cast("double")), keys, score, "_r")
    p, n = F.count(F.when(F.col(truth), 1)), F.count(F.when(~F.col(truth), 1))
    out = x.groupBy(*keys).agg(p.alias("positives"), n.alias("negatives"), F.sum(F.when(F.col(truth), F.col("_r"))).alias("_s"))
    u = F.col("_s") - F.col("positives") * (F.col("positives") + 1) / 2
    return out.withColumn("auroc", F.try_divide(u, F.col("positives") * F.col("negatives"))).drop("_s")


def cumulative(df: DataFrame, keys: list[str], score: str, truth: str) -> DataFrame:
    """keys, threshold, tp, fp, positives: what score >= threshold finds, one row for each distinct score."""
    x = known(df, score, truth).groupBy(*keys, F.col(score).alias("threshold")).agg(F.count(F.when(F.col(truth), 1)).alias("_p"), F.count(F.when(~F.col(truth), 1)).alias("_n"))
    down = Window.partitionBy(*keys).orderBy(F.col("threshold").desc()).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("tp", F.sum("_p").over(down)).withColumn("fp", F.sum("_n").over(down))
    return x.withColumn("positives", F.sum("_p").over(Window.partitionBy(*keys))).drop("_p", "_n")


def with_f1(curve: DataFrame) -> DataFrame:
    """precision (null if nothing is found), recall and f1 (0 if both are 0)."""
    x = curve.withColumn("precision", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide(F.col("tp"), F.col("positives")))
    return x.withColumn("f1", F.try_divide(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("positives")))


def best_f1(df: DataFrame, keys: list[str], score: str, truth: str) -> DataFrame:
    """The threshold with the largest F1, of equal ones the highest."""
    x = with_f1(cumulative(df, keys, score, truth)).filter(F.col("positives") > 0)
    w = Window.partitionBy(*keys).orderBy(F.col("f1").desc(), F.col("threshold").desc())
    return x.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def recall_floor(df: DataFrame, keys: list[str], score: str, truth: str, floor: float = 0.8) -> DataFrame:
    """The highest threshold whose recall reaches the floor."""
    x = with_f1(cumulative(df, keys, score, truth)).filter(F.col("recall") >= floor)
    w = Window.partitionBy(*keys).orderBy(F.col("threshold").desc())
    return x.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def confusion(df: DataFrame, keys: list[str], score: str, truth: str, threshold: float) -> DataFrame:
    hit = F.col(score) >= threshold
    cells = {"tp": hit & F.col(truth), "fp": hit & ~F.col(truth), "fn": ~hit & F.col(truth), "tn": ~hit & ~F.col(truth)}
    return known(df, score, truth).groupBy(*keys).agg(*(F.count(F.when(c, 1)).alias(n) for n, c in cells.items()))


def leave_one_group_out(df: DataFrame, group: str, score: str, truth: str) -> DataFrame:
    """group, threshold, tp, fp, fn, tn: each group judged by the best F1 threshold of all the others. Counts by group and score are taken once and subtracted."""
    x = known(df, score, truth).groupBy(group, F.col(score).alias("threshold")).agg(F.count(F.when(F.col(truth), 1)).alias("p"), F.count(F.when(~F.col(truth), 1)).alias("n"))
    every = x.groupBy("threshold").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    groups = x.select(group).distinct()
    rest = groups.join(every).join(x.select(group, "threshold", F.col("p").alias("own_p"), F.col("n").alias("own_n")), [group, "threshold"], "left")  # groups x scores, both counted already
    rest = rest.select(group, "threshold", (F.col("p") - F.coalesce("own_p", F.lit(0))).alias("p"), (F.col("n") - F.coalesce("own_n", F.lit(0))).alias("n")).filter("p + n > 0")
    down = Window.partitionBy(group).orderBy(F.col("threshold").desc()).rowsBetween(Window.unboundedPreceding, 0)
    curve = rest.withColumn("tp", F.sum("p").over(down)).withColumn("fp", F.sum("n").over(down)).withColumn("positives", F.sum("p").over(Window.partitionBy(group)))
    w = Window.partitionBy(group).orderBy(F.col("f1").desc_nulls_last(), F.col("threshold").desc())
    cut = with_f1(curve).withColumn("_k", F.row_number().over(w)).filter("_k = 1").select(group, F.col("threshold").alias("cut"))
    y = x.join(cut, group)
    hit = F.col("threshold") >= F.col("cut")
    return y.groupBy(group, F.col("cut").alias("threshold")).agg(
        F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("p")).otherwise(0)).alias("fn"), F.sum(F.when(~hit, F.col("n")).otherwise(0)).alias("tn"),
    )


def combined_confidence(df: DataFrame, ranks: list[str], support: str | None = None, least_support: int = 2, cut: float = 0.1) -> DataFrame:
    """confidence (mean of the ranks, null if one is missing) and abstain: unknown, little support, or in the lowest cut of all."""
    missing = F.greatest(*(F.col(r).isNull().cast("int") for r in ranks)) == 1 if len(ranks) > 1 else F.col(ranks[0]).isNull()
    x = df.withColumn("confidence", F.when(~missing, sum((F.col(r) for r in ranks), F.lit(0.0)) / len(ranks)))
    low = x.agg(F.percentile("confidence", F.lit(cut)).alias("_low"))
    weak = F.col("confidence").isNull() | (F.col("confidence") <= F.col("_low"))
    if support is not None:
        weak = weak | (F.col(support) < least_support)
    return x.join(F.broadcast(low)).withColumn("abstain", F.coalesce(weak, F.lit(True))).drop("_low")  # low is one row
