"""File streams: tumbling and session windows with a watermark, and a check that a sequence has no gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def follow(spark: SparkSession, path: str, schema: str, files: int = 10) -> DataFrame:
    """Rows of JSON-lines files as they are put into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def tumbling(df: DataFrame, at: str, width: str, late: str, keys: list[str], **measures) -> DataFrame:
    """start, keys and measures of each closed window; rows later than late are left out."""
    out = df.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(*(m.alias(n) for n, m in measures.items()))
    return out.select(F.col("window.start").alias("start"), *keys, *measures)


def sessions(df: DataFrame, at: str, gap: str, late: str, keys: list[str], **measures) -> DataFrame:
    """start, stop, keys and measures of sessions that end after gap without a row."""
    out = df.withWatermark(at, late).groupBy(F.session_window(at, gap), *keys).agg(*(m.alias(n) for n, m in measures.items()))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), *keys, *measures)


def missing(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """keys, low, high, missing of batches whose sequence numbers leave some out; for foreachBatch or a finished table."""
    out = df.groupBy(*keys).agg(F.min(sequence).alias("low"), F.max(sequence).alias("high"), F.count_distinct(sequence).alias("_n"))
    return out.withColumn("missing", F.col("high") - F.col("low") + 1 - F.col("_n")).drop("_n").filter("missing > 0")
