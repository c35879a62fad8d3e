"""Interval labels from delimited text, cut to a window and put on its clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def segments(spark: SparkSession, path: str, schema: str, start: str, stop: str, window: tuple[int, int], sep: str = ",", header: bool = True, rate: float = 1.0) -> DataFrame:
    """Rows whose [start, stop) meets the window, with local_start and local_stop counted from its start at rate."""
    df = spark.read.schema(schema).option("header", header).option("sep", sep).csv(path)
    low, high = window
    x = df.filter((F.col(start) < high) & (F.col(stop) > low))
    return x.withColumn("local_start", (F.greatest(F.col(start), F.lit(low)) - low) * rate).withColumn("local_stop", (F.least(F.col(stop), F.lit(high)) - low) * rate)
