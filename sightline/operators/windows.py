"""Ranks, rolling statistics and lags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def average_rank(df: DataFrame, keys: list[str], value: str, name: str = "rank") -> DataFrame:
    """Ranks from 1, ties sharing their mean; missing values have none. Values are counted before they are ranked, so ties cost one row."""
    counts = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn(name, F.coalesce(F.sum("_n").over(before), F.lit(0)) + (F.col("_n") + 1) / 2).drop("_n")
    return df.join(ranks, [*keys, value], "left")


def normalized_rank(df: DataFrame, keys: list[str], value: str, name: str = "rank") -> DataFrame:
    """Average ranks scaled to 0..1; a lone value has 0.5."""
    x = average_rank(df, keys, value, "_r")
    n = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys).agg(F.count("*").alias("_count"))
    x = x.join(n, keys, "left") if keys else x.join(F.broadcast(n))
    return x.withColumn(name, F.when(F.col("_r").isNotNull(), F.when(F.col("_count") == 1, 0.5).otherwise((F.col("_r") - 1) / (F.col("_count") - 1)))).drop("_r", "_count")


def rolling_median(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int, least: int = 1, name: str = "median") -> DataFrame:
    """The exact median of the rows before this one, missing values left out; null with fewer than least."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-rows, -1)
    return df.withColumn(name, F.when(F.count(value).over(w) >= least, F.percentile(value, F.lit(0.5)).over(w)))


def exact_lag(df: DataFrame, keys: list[str], at: str, value: str, lag: int, name: str = "lagged") -> DataFrame:
    """The value exactly lag steps ago: null where that step has no row."""
    past = df.select(*keys, (F.col(at) + lag).alias(at), F.col(value).alias(name))
    return df.join(past, [*keys, at], "left")


def robust_z(df: DataFrame, keys: list[str], value: str, name: str = "z") -> DataFrame:
    """Distance from the group's median in scaled median absolute deviations; null where these are 0."""
    middle = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("_m"))
    x = df.join(middle, keys)
    mad = x.groupBy(*keys).agg(F.percentile(F.abs(F.col(value) - F.col("_m")), F.lit(0.5)).alias("_d"))
    return x.join(mad, keys).withColumn(name, F.when(F.col("_d") > 0, 0.6745 * (F.col(value) - F.col("_m")) / F.col("_d"))).drop("_m", "_d")


def first_of(df: DataFrame, keys: list[str], *order: Column, k: int = 1) -> DataFrame:
    """The first k rows of each group in a total order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_k") <= k).drop("_k")
