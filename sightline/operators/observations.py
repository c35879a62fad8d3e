"""The observation table: from detector records, through selection, to per-frame streams.

Observations are rows (view, frame, slot, object_class, score, box, source, pose_valid); sources are detector and mask.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.functions.expressions import box_centre, distance, slot_label, strided


def from_records(records: DataFrame, least_score: float) -> DataFrame:
    """Records (view, frame, detections array<struct<class, score, box>>) to one observation a detection of at least least_score, ranked by score within its view, frame and class; ties keep file order."""
    x = records.select("view", "frame", F.posexplode("detections").alias("at", "d")).filter(F.col("d.score") >= least_score)
    rank = F.row_number().over(Window.partitionBy("view", "frame", "d.class").orderBy(F.col("d.score").desc(), "at")) - 1
    return x.select(
        "view", "frame", slot_label(F.col("d.class"), rank).alias("slot"), F.col("d.class").alias("object_class"), F.col("d.score").alias("score"), F.col("d.box").alias("box"),
        F.lit("detector").alias("source"), F.lit(True).alias("pose_valid"),
    )


def with_pose(observations: DataFrame, poses: DataFrame, moving_view: str) -> DataFrame:
    """pose_valid of the moving view from poses (frame, valid), false where it isn't known; other views are left as they are."""
    x = observations.join(poses.select("frame", F.col("valid").alias("_valid")), "frame", "left")
    flag = F.when(F.col("view") == moving_view, F.coalesce("_valid", F.lit(False))).otherwise(F.col("pose_valid"))
    return x.withColumn("pose_valid", flag).drop("_valid").select(*observations.columns)


def select(observations: DataFrame, least_score: float = 0.3, gate: float = 30.0) -> DataFrame:
    """What a tracker is given, with confirmed: valid poses only; detector rows of at least least_score, and none where the view has mask rows of that class in that frame.

    A mask row is confirmed by its own score or by a detector row of its class whose centre lies within gate.
    """
    key = ["view", "frame", "object_class"]
    x = observations.filter("pose_valid")
    masks, detector = x.filter("source = 'mask'"), x.filter((F.col("source") != "mask") & (F.col("score") >= least_score))
    alone = detector.join(masks.select(*key).distinct(), key, "left_anti").withColumn("confirmed", F.lit(True))
    centres = detector.groupBy(*key).agg(F.collect_list(box_centre(F.col("box"))).alias("_near"))  # detections of one class in one frame
    near = F.exists(F.coalesce("_near", F.array().cast("array<array<double>>")), lambda c: distance(c, box_centre(F.col("box"))) <= gate)
    told = masks.join(centres, key, "left").withColumn("confirmed", F.coalesce(F.col("score") >= least_score, F.lit(False)) | F.coalesce(near, F.lit(False)))
    return alone.unionByName(told.drop("_near"))


def keep_seeded(observations: DataFrame, seeds: DataFrame) -> DataFrame:
    """Mask rows whose (view, slot) is among the seeds; rows of other sources pass."""
    masks = observations.filter("source = 'mask'").join(seeds.select("view", "slot").distinct(), ["view", "slot"], "left_semi")
    return observations.filter("source <> 'mask'").unionByName(masks.select(*observations.columns))


def frame_plan(views: DataFrame, start: int, count: int, stride: int, moving_stride: int) -> DataFrame:
    """(view, frame, coverage): every stride-th frame of each view (view, moving), the last always among them."""
    plan = F.when(F.col("moving"), strided(F.lit(start), F.lit(count), moving_stride)).otherwise(strided(F.lit(start), F.lit(count), stride))
    coverage = F.when(F.when(F.col("moving"), moving_stride).otherwise(stride) == 1, "every frame").otherwise("strided")
    return views.select("view", F.explode(plan).alias("frame"), coverage.alias("coverage"))


def box_stream(observations: DataFrame) -> DataFrame:
    """(view, frame, boxes): one row a frame with its slots in order."""
    return observations.groupBy("view", "frame").agg(F.array_sort(F.collect_list(F.struct("slot", "score", "box"))).alias("boxes"))
