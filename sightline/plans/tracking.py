"""Identity tracking, triangulation and alignment over synthetic views of the driver tables. Nothing here can be told in SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sightline.catalog import query
from sightline.operators import folds, geometry, tracker
from sightline.plans.tables import events, load

#: Three 3x4 cameras that look along z from different places.
CAMERAS = {
    "left": [[800.0, 0.0, 320.0, 40000.0], [0.0, 800.0, 240.0, 0.0], [0.0, 0.0, 1.0, 200.0]],
    "middle": [[800.0, 0.0, 320.0, 64000.0], [0.0, 800.0, 240.0, 48000.0], [0.0, 0.0, 1.0, 200.0]],
    "right": [[800.0, 0.0, 320.0, 90000.0], [0.0, 800.0, 240.0, 20000.0], [0.0, 0.0, 1.0, 220.0]],
}


def observations(spark, sf_dir):
    """Each event type is an object of each trial (user modulo 8) whose place drifts with the hour; every camera sees it."""
    e = events(spark, sf_dir).select((F.col("user_id") % 8).alias("trial"), "frame", F.col("event_type").alias("object_class")).distinct()
    k = F.pmod(F.hash("object_class"), F.lit(5)) * 30.0
    e = e.withColumn("p", F.array(k + F.sin(F.col("frame") / 9.0) * 5, F.cos(F.col("frame") / 9.0) * 5, k / 10, F.lit(1.0)))
    rows = [(v, [float(x) for r in c for x in r]) for v, c in CAMERAS.items()]
    cameras = F.broadcast(spark.createDataFrame(rows, "view string, camera array<double>"))  # three rows
    x = e.join(cameras)
    line = lambda i: F.aggregate(F.zip_with(F.slice("camera", 4 * i + 1, 4), "p", lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    return x.select("trial", "frame", "object_class", "view", "camera", (line(0) / line(2)).alias("u"), (line(1) / line(2)).alias("v"))


@query("tracker_batch")
def tracker_batch(spark, sf_dir):
    return tracker.track(observations(spark, sf_dir), "trial", CAMERAS)


@query("triangulate_dlt")
def triangulate_dlt(spark, sf_dir):
    return geometry.triangulated(observations(spark, sf_dir), ["trial", "frame", "object_class"])


@query("line_fit")
def line_fit(spark, sf_dir):
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        centre, direction, rms = geometry.fit_line(rows[["frame", "value"]].to_numpy(float))
        return pd.DataFrame([{"user_id": rows["user_id"].iloc[0], "x": centre[0], "y": centre[1], "slope": direction[1] / direction[0] if direction[0] else np.nan, "rms": rms}])

    x = events(spark, sf_dir).select("user_id", "frame", "value")
    few = x.groupBy("user_id").count().filter("count >= 2").select("user_id")
    return x.join(few, "user_id", "left_semi").groupBy("user_id").applyInPandas(one, "user_id long, x double, y double, slope double, rms double")


STEPS = 8
KEEP = 0.3


def _aligned(spark, sf_dir, f, schema):
    return load(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").alias("scores")).groupBy("label").applyInPandas(f, schema)


def _vectors(rows: pd.DataFrame) -> np.ndarray:
    return np.stack(rows["scores"].to_list()).astype(float)


@query("monotonic_dp")
def monotonic_dp(spark, sf_dir):
    """The values of an embedding as the scores of so many steps."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        return pd.DataFrame({"label": rows["label"], "vec_id": rows["vec_id"], "step": folds.monotonic_path(_vectors(rows), free_start=False)})

    return _aligned(spark, sf_dir, one, "label int, vec_id long, step long")


@query("drop_dtw")
def drop_dtw(spark, sf_dir):
    """STEPS embeddings at even distances are the steps; a pair costs 1 - cosine, dropping a sample the KEEP quantile of its costs."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        x = _vectors(rows.sort_values("vec_id"))
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        cost = 1 - x @ x[np.linspace(0, len(x) - 1, min(STEPS, len(x))).round().astype(int)].T
        total, pairs = folds.drop_dtw(cost, np.quantile(cost, KEEP, axis=1))
        return pd.DataFrame([{"label": rows["label"].iloc[0], "cost": total, "matched": len(pairs)}])

    return _aligned(spark, sf_dir, one, "label int, cost double, matched long")
