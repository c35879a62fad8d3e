"""Joins beyond equality: intervals, overlaps, nearest keys. Ranges are dealt into buckets so that every join is an equi-join first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _buckets(start: Column, stop: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(stop / width)))


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, stop: str, width: int, closed: bool = False) -> DataFrame:
    """Each point with every interval [start, stop) (or [start, stop]) of its key that holds it."""
    left = points.withColumn("_bucket", F.floor(F.col(at) / width))
    right = intervals.withColumn("_bucket", _buckets(F.col(start), F.col(stop) - (0 if closed else 1), width))
    out = left.join(right, [*keys, "_bucket"])
    holds = (F.col(at) >= F.col(start)) & ((F.col(at) <= F.col(stop)) if closed else (F.col(at) < F.col(stop)))
    return out.filter(holds).drop("_bucket")


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], a_range: tuple[str, str], b_range: tuple[str, str], width: int) -> DataFrame:
    """Pairs whose half-open ranges share a point. A pair is made in the first bucket that both reach, once."""
    left = a.withColumn("_bucket", _buckets(F.col(a_range[0]), F.col(a_range[1]) - 1, width))
    right = b.withColumn("_bucket", _buckets(F.col(b_range[0]), F.col(b_range[1]) - 1, width))
    first = F.floor(F.greatest(F.col(a_range[0]), F.col(b_range[0])) / width)
    both = (F.col(a_range[0]) < F.col(b_range[1])) & (F.col(b_range[0]) < F.col(a_range[1])) & (F.col("_bucket") == first)
    return left.join(right, [*keys, "_bucket"]).filter(both).drop("_bucket")


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, strictly: bool = False, forward: bool = False) -> DataFrame:
    """Each left row with matched_at and matched, the last right row at or before it (forward: the first at or after). One sort of the union, no range join."""
    r = right.select(*keys, F.col(at).alias("_t"), F.struct(F.col(at).alias("t"), F.col(value).alias("v")).alias("_r"), F.lit(1 if strictly != forward else 0).alias("_side"))
    l = left.select("*", F.col(at).alias("_t"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.lit(0 if strictly != forward else 1).alias("_side"))  # noqa: E741
    both = l.unionByName(r, allowMissingColumns=True)
    order = [F.col("_t"), F.col("_side"), F.col("_r.v")]
    order = [c.desc() for c in order] if forward else order  # forward reads backwards, so that the frame only grows
    found = F.last("_r", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn("_f", found).filter(F.col("_r").isNull()).select(*left.columns, F.col("_f.t").alias("matched_at"), F.col("_f.v").alias("matched"))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, within: int | None = None) -> DataFrame:
    """Each left row with nearest_at, the closest right key on either side, the earlier one of two as close."""
    x = asof(left, right, keys, at, at).withColumnRenamed("matched_at", "_before").drop("matched")
    x = asof(x, right, keys, at, at, forward=True).withColumnRenamed("matched_at", "_after").drop("matched")
    back, ahead = F.col(at) - F.col("_before"), F.col("_after") - F.col(at)
    best = F.when(F.col("_after").isNull() | (back <= ahead), F.col("_before")).otherwise(F.col("_after"))
    x = x.withColumn("nearest_at", best).drop("_before", "_after")
    return x if within is None else x.withColumn("nearest_at", F.when(F.abs(F.col("nearest_at") - F.col(at)) <= within, F.col("nearest_at")))


def prefer(df: DataFrame, keys: list[str], source: str, order: list[str]) -> DataFrame:
    """Rows of the first source of order that a key has: one window, no self-join."""
    rank = F.coalesce(*(F.when(F.col(source) == s, i) for i, s in enumerate(order)), F.lit(len(order)))
    x = df.withColumn("_rank", rank)
    return x.withColumn("_best", F.min("_rank").over(Window.partitionBy(*keys))).filter("_rank = _best").drop("_rank", "_best")


def full_status(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of either side with status both, left or right."""
    x = a.select(*keys).distinct().withColumn("_a", F.lit(True))
    y = b.select(*keys).distinct().withColumn("_b", F.lit(True))
    return x.join(y, keys, "full").withColumn("status", F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "left").otherwise("right")).drop("_a", "_b")
