"""JSON-lines scans, strict and tolerant, and sorted, compact sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def strict(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows by a closed schema. A line that isn't JSON of these types, or holds a key that the schema doesn't, fails the read."""
    shape = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    lines = spark.read.text(path).filter(F.trim("value") != "")
    keys = F.coalesce(F.json_object_keys("value"), F.array(F.lit("not an object")))
    unknown = F.array_except(keys, F.array(*(F.lit(f.name) for f in shape.fields)))
    checked = F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown keys: "), F.array_join(unknown, ", "), F.lit(" in "), F.col("value")))).otherwise(F.col("value"))
    return lines.select(F.from_json(checked, shape, {"mode": "FAILFAST"}).alias("_r")).select("_r.*")


def tolerant(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Known fields; other keys are passed over and bad values are null."""
    return spark.read.text(path).filter(F.trim("value") != "").select(F.from_json("value", schema).alias("_r")).select("_r.*")


def prefiltered(spark: SparkSession, path: str, schema: StructType | str, *needles: str) -> DataFrame:
    """Only lines that contain one of the needles are parsed."""
    lines = spark.read.text(path)
    keep = F.lit(False)
    for n in needles:
        keep = keep | F.contains("value", F.lit(n))
    return lines.filter(keep).select(F.from_json("value", schema).alias("_r")).select("_r.*")


def last_by(df: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Of rows that repeat a key the last line wins."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(line).desc()))).filter("_k = 1").drop("_k")


def violations(df: DataFrame, **rules) -> DataFrame:
    """The rows that break a rule (a boolean column each; unknown passes), with the names of those they break."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(r, F.lit(True)), n) for n, r in rules.items())))
    return df.withColumn("violations", broken).filter(F.size("violations") > 0)


def write_sorted(df: DataFrame, path: str, *order: str, files: int = 8) -> None:
    """JSON lines in global order, nulls left out."""
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").option("ignoreNullFields", "true").json(path)
