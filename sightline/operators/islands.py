"""Gaps and islands: runs, merged intervals, flagged episodes, bounded filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


ROUNDS = 10_000


def _w(keys, *order):
    return Window.partitionBy(*keys).orderBy(*order)


def runs(df: DataFrame, keys: list[str], at: str, max_gap: int = 0) -> DataFrame:
    """keys, first, last, n of each run: a run breaks where more than max_gap steps have no row. Inclusive ends; repeated steps count once."""
    x = df.select(*keys, F.col(at).alias("_at")).filter(F.col("_at").isNotNull()).distinct()
    fresh = F.coalesce(F.col("_at") - F.lag("_at").over(_w(keys, "_at")) > max_gap + 1, F.lit(True))
    x = x.withColumn("_run", F.sum(fresh.cast("int")).over(_w(keys, "_at").rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*keys, "_run").agg(F.min("_at").alias("first"), F.max("_at").alias("last"), F.count("*").alias("n")).drop("_run")


def merge_intervals(df: DataFrame, keys: list[str], start: str, stop: str, gap: int = 0, shortest: int | None = None) -> DataFrame:
    """keys, start, stop, n: half-open intervals joined where one starts less than or at gap after all before it have ended; then those shorter than shortest are dropped.

    Intervals without a start come last and count towards the last run; alone they are a run without ends. Both windows read one sort, so equal intervals stand in one order for both.
    """
    x = df.select(*keys, F.col(start).alias("start"), F.col(stop).alias("stop"))
    w = _w(keys, F.col("start").asc_nulls_last(), F.col("stop").asc_nulls_last())
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach + gap), 1).otherwise(0))
    x = x.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = x.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n")).drop("_run")
    return out if shortest is None else out.filter(F.col("stop") - F.col("start") >= shortest)


def state_runs(df: DataFrame, keys: list[str], at: str, state: str | Column, neutral: bool = True) -> DataFrame:
    """keys, state, first, last, n of runs of equal state in row order. With neutral, null states neither extend nor break a run; else they are a state."""
    x = df.select(*keys, F.col(at).alias("_at"), (F.col(state) if isinstance(state, str) else state).alias("state"))
    if neutral:
        x = x.filter(F.col("state").isNotNull())
    before = F.lag(F.struct("state")).over(_w(keys, "_at"))
    fresh = before.isNull() | ~before["state"].eqNullSafe(F.col("state"))
    x = x.withColumn("_run", F.sum(fresh.cast("int")).over(_w(keys, "_at").rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*keys, "_run").agg(F.first("state").alias("state"), F.min("_at").alias("first"), F.max("_at").alias("last"), F.count("*").alias("n")).drop("_run")


def gaps(df: DataFrame, keys: list[str], at: str, longer: int = 0) -> DataFrame:
    """keys, after, before, missing: steps without a row between two rows, where there are more than longer of them."""
    x = df.select(*keys, F.col(at).alias("before")).distinct()
    x = x.withColumn("after", F.lag("before").over(_w(keys, "before")))
    x = x.withColumn("missing", F.col("before") - F.col("after") - 1)
    return x.filter(F.col("missing") > longer).select(*keys, "after", "before", "missing")


def fill_bounded(grid: DataFrame, keys: list[str], at: str, value: str, between: int = 5, hold: int = 3) -> DataFrame:
    """filled: a missing value interpolated where both sides exist and the gap is at most between, held where one side exists within hold steps."""
    back = _w(keys, at).rowsBetween(Window.unboundedPreceding, 0)
    ahead = _w(keys, F.col(at).desc()).rowsBetween(Window.unboundedPreceding, 0)  # read backwards, so that the frame only grows
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("t"), F.col(value).alias("v")))
    x = grid.withColumn("_p", F.last(known, ignorenulls=True).over(back)).withColumn("_n", F.last(known, ignorenulls=True).over(ahead))
    p, n, t = F.col("_p"), F.col("_n"), F.col(at)
    gap = n["t"] - p["t"] - 1
    drawn = p["v"] + (n["v"] - p["v"]) * (t - p["t"]) / (n["t"] - p["t"])
    held = F.when(n.isNull() & (t - p["t"] <= hold), p["v"]).when(p.isNull() & (n["t"] - t <= hold), n["v"])
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(p.isNotNull() & n.isNotNull(), F.when(gap <= between, drawn)).otherwise(held)
    return x.withColumn("filled", filled).drop("_p", "_n")


def round_robin(df: DataFrame, kind: str, *order: Column) -> DataFrame:
    """rank: the k-th best of each kind comes before any (k + 1)-th; within a round kinds keep the order of their scores."""
    x = df.withColumn("_k", F.row_number().over(Window.partitionBy(kind).orderBy(*order)))
    starts = x.groupBy("_k").count().withColumn("_bucket", F.floor(F.col("_k") / ROUNDS))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for so many rounds
    buckets = starts.groupBy("_bucket").agg(F.sum("count").alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    before = Window.partitionBy("_bucket").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).join(buckets, "_bucket").select("_k", (F.col("_before") + F.col("_base")).alias("_before"))
    x = x.join(starts, "_k")
    return x.withColumn("rank", F.col("_before") + F.row_number().over(Window.partitionBy("_k").orderBy(*order))).drop("_k", "_before")
