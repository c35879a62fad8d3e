"""The query catalogue over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sightline.catalog import ORACLES, QUERIES
from sightline.plans import cameras, lines, observations, projections, regions, reviews, selection, series, settings, statistics, tracking  # noqa: F401  (they register the queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations.episodes_max_gap(spark, sf_dir)
