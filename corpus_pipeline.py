"""The corpus pipeline: quality, near duplicates, repeats, benchmark passages, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as
the next stage's docs. Stages but the last return the columns of documents; the last adds the mix_ columns.
Every stage works on all rows it is given, repeated rows, null texts and empty texts included.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import decontaminate, jaccard, mixing, quality, suffix
from sightline.llm.native import shared_checkpoints, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier draws; those it rejects go."""
    return quality.Classifier(docs, table(spark, sf_dir, "labels")).sample(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked at 0.8 of their five-word shingles: the one with the smallest id.

    Of rows that repeat an id the first by text stays. Rows without an id stay.
    """
    return jaccard.keep_one(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat elsewhere; n_chars follows. Every document stays, what is left of a cut character goes."""
    return suffix.without_repeats(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its place in the mixture of sources."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("suffix-array dedup", repeats_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing sources to target weights", mixture_stage),
]

#: The classifier's draw can't be told in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is written to the session's shared checkpoint folder."""
    shared_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
