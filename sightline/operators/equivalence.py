"""Whether two tables hold the same rows, whatever their order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def digest(df: DataFrame, *columns: str) -> DataFrame:
    """rows, total, low: an order-free digest; md5 of each row as a number, added and xor-ed."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns or df.columns]
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *cells)), 1, 12), 16, 10).cast("long")
    return df.select(h.alias("h")).agg(F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("total"), F.bit_xor("h").alias("low"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows that one side has more often, with side and times."""
    n = a.columns
    both = a.select(*n, F.lit(1).alias("_d")).unionByName(b.select(*n, F.lit(-1).alias("_d"))).groupBy(*n).agg(F.sum("_d").alias("_d"))
    return both.filter("_d != 0").select(*n, F.when(F.col("_d") > 0, "left").otherwise("right").alias("side"), F.abs("_d").alias("times"))
