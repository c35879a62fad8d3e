from pyspark.sql import functions as F

from sightline.operators import observations as O  # noqa: E741

KEY = "view string, frame long, slot string, object_class string, score double, box array<double>, source string, pose_valid boolean"


def test_detections_are_ranked_by_class(spark):
    one = [("cup", 0.5, [0.0] * 4), ("cup", 0.9, [1.0] * 4), ("pen", 0.2, [2.0] * 4), ("cup", 0.5, [3.0] * 4)]
    df = spark.createDataFrame([("a", 1, one)], "view string, frame long, detections array<struct<class: string, score: double, box: array<double>>>")
    got = {r.slot: r.box[0] for r in O.from_records(df, 0.3).collect()}
    assert got == {"cup#0": 1.0, "cup#1": 0.0, "cup#2": 3.0}


def test_masks_take_the_place_of_detections(spark):
    rows = [
        ("a", 1, "cup#0", "cup", 0.9, [0.0, 0.0, 2.0, 2.0], "detector", True), ("a", 1, "m", "cup", None, [10.0, 0.0, 12.0, 2.0], "mask", True),
        ("b", 1, "cup#0", "cup", 0.9, [0.0, 0.0, 2.0, 2.0], "detector", True), ("b", 1, "cup#1", "cup", 0.1, [0.0, 0.0, 2.0, 2.0], "detector", True),
        ("c", 1, "m", "cup", None, [90.0, 0.0, 92.0, 2.0], "mask", True), ("fpv", 1, "cup#0", "cup", 0.9, [0.0, 0.0, 2.0, 2.0], "detector", True),
    ]
    df = O.with_pose(spark.createDataFrame(rows, KEY), spark.createDataFrame([(2, True)], "frame long, valid boolean"), "fpv")
    got = sorted((r.view, r.slot, r.confirmed) for r in O.select(df).collect())
    assert got == [("a", "m", True), ("b", "cup#0", True), ("c", "m", False)]
    kept = O.keep_seeded(df, spark.createDataFrame([("a", "m")], "view string, slot string"))
    assert sorted((r.view, r.slot) for r in kept.filter("source = 'mask'").collect()) == [("a", "m")] and kept.count() == 5
    assert O.box_stream(df).filter("view = 'b'").select(F.size("boxes")).first()[0] == 2


def test_frame_plans_end_on_the_last_frame(spark):
    views = spark.createDataFrame([("a", False), ("fpv", True)], "view string, moving boolean")
    got = {}
    for r in O.frame_plan(views, 10, 8, 3, 1).collect():
        got.setdefault((r.view, r.coverage), []).append(r.frame)
    assert got == {("a", "strided"): [10, 13, 16, 17], ("fpv", "every frame"): list(range(10, 18))}
