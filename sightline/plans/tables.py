"""Driver tables in the roles of the observation model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.expressions import frame_of

#: DuckDB: events with their hour, as the common table e.
E = "e AS (SELECT *, CAST(date_diff('second', TIMESTAMP '1970-01-01 00:00:00', ts) // 3600 AS BIGINT) AS frame FROM events)"
#: DuckDB: labelled documents with their length as the score, as the common table d.
D = "d AS (SELECT doc_id, lang, source, n_chars AS score, toxic = 1 AS truth, quality FROM documents JOIN labels USING (doc_id))"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("frame", frame_of("ts"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars").alias("score"))
    labels = load(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("truth"), "quality")
    return docs.join(labels, "doc_id")
