"""The motion of a whole moving view, from what its frames share, and what moves against it.

Steps between neighbouring frames are robust maps of shared centres, one small fit each. The map from a key's first frame on is an ordered product; it is
made by blocks of frames: products inside each block, products of the blocks' totals, and one multiplication that joins them. So a
key of any length is spread over tasks, and no fold walks it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.graph import checkpoints
from sightline.operators.poses import _typed

EYE = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def robust_map(source: np.ndarray, target: np.ndarray, affine: int = 6, shift: int = 3, trim: float = 0.25, inlier: float = 5.0) -> np.ndarray:
    """The 3x3 map that carries source points onto target: affine by least squares over all, then without the worst share, then over those within the larger of inlier
    and two median residuals, each as long as enough points are left; the median shift with fewer points than affine, and no motion with fewer than shift."""
    out = np.eye(3)
    if len(source) < affine:
        if len(source) >= shift:
            out[:2, 2] = np.median(target - source, axis=0)
        return out
    design = np.column_stack([source, np.ones(len(source))])

    def fit(keep) -> np.ndarray:
        return np.linalg.lstsq(design[keep], target[keep], rcond=None)[0]

    def away(x) -> np.ndarray:
        return np.linalg.norm(design @ x - target, axis=1)

    x = fit(slice(None))
    off = away(x)
    keep = off <= np.quantile(off, 1 - trim)
    if keep.sum() >= affine:
        x = fit(keep)
        off = away(x)
        keep = off <= max(inlier, 2 * float(np.median(off)))
        if keep.sum() >= affine:
            x = fit(keep)
    out[:2] = x.T
    return out


def step_maps(df: DataFrame, keys: list[str], frame: str, item: str, x: str, y: str) -> DataFrame:
    """keys, frame, before, shared, map (nine values, row by row): the motion from a key's frame before to frame, by the centres of items that both have.

    Rows without a frame, item or centre don't count, and of several centres of one item in one frame their mean does. A key's first frame has before
    null, nothing shared and the map that moves nothing.
    """
    told = df.where(F.col(frame).isNotNull() & F.col(item).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    centres = told.groupBy(*keys, F.col(frame).cast("long").alias("_f"), F.col(item).alias("_i")).agg(F.avg(x).alias("_x"), F.avg(y).alias("_y"))
    frames = centres.select(*keys, "_f").distinct().withColumn("_b", F.lag("_f").over(Window.partitionBy(*keys).orderBy("_f")))
    now = centres.join(frames, [*keys, "_f"])
    was = centres.select(*keys, F.col("_f").alias("_b"), "_i", F.col("_x").alias("_sx"), F.col("_y").alias("_sy"))
    pairs = now.join(was, [*keys, "_b", "_i"]).groupBy(*keys, "_f").agg(F.array_sort(F.collect_list(F.struct("_i", "_sx", "_sy", "_x", "_y"))).alias("_pairs"))  # what one frame shows

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[[*keys, "_f"]].copy()
            points = [np.array([[p["_sx"], p["_sy"], p["_x"], p["_y"]] for p in row], float) for row in b["_pairs"]]
            out["shared"], out["map"] = [len(p) for p in points], [robust_map(p[:, :2], p[:, 2:]).ravel() for p in points]
            yield out

    fitted = pairs.mapInPandas(fit, _typed(df, keys) + "_f long, shared long, map array<double>")
    still = F.array(*(F.lit(v) for v in EYE))
    return frames.join(fitted, [*keys, "_f"], "left").select(*keys, F.col("_f").alias(frame), F.col("_b").alias("before"), F.coalesce("shared", F.lit(0).cast("long")).alias("shared"), F.coalesce("map", still).alias("map"))


def product(a: Column, b: Column) -> Column:
    """The 3x3 map that does b, then a."""
    return F.array(*(sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)))


def composed(steps: DataFrame, keys: list[str], at: str, step: str = "map", block: int = 1024, origin: int = 0) -> DataFrame:
    """keys, at, whole: the product of all steps of a key up to at, the latest on the left. at is unique in its key and says the order.

    Blocks are stretches of at, counted from origin. Their totals are composed the same way, so each level has up to block times fewer rows and a task holds one block.
    """

    checkpoints(steps.sparkSession)

    def local(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(at)
        so_far, out = np.eye(3), []
        for m in rows[step]:
            so_far = np.asarray(m, float).reshape(3, 3) @ so_far
            out.append(so_far.ravel())
        return rows[[*keys, at, "_block"]].assign(_local=out, _last=np.arange(len(rows)) == len(rows) - 1)

    x = steps.select(*keys, F.col(at).cast("long").alias(at), step).withColumn("_block", F.floor((F.col(at) - origin) / block))
    x = x.groupBy(*keys, "_block").applyInPandas(local, _typed(steps, keys) + f"`{at}` long, _block long, _local array<double>, _last boolean").checkpoint()
    totals = x.filter("_last").select(*keys, F.col("_block").alias("_order"), F.col("_local").alias("_total"))
    ends = totals.agg(F.min("_order"), F.max("_order")).first()
    if ends[0] == ends[1]:  # a single block for every key, or no rows
        return x.select(*keys, at, F.col("_local").alias("whole"))
    whole = composed(totals, keys, "_order", "_total", block, ends[0]).select(*keys, "_order", "whole")
    before = whole.withColumn("_before", F.lag("whole").over(Window.partitionBy(*keys).orderBy("_order"))).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_order").alias("_to"), "_before")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_block") == F.col("_to")]
    return x.join(before, same).select(*keys, at, F.when(F.col("_before").isNull(), F.col("_local")).otherwise(product(F.col("_local"), F.col("_before"))).alias("whole"))


def inverse(m: Column) -> Column:
    """Of a 3x3 map; null if it has none."""
    minor = lambda a, b, c, d: m[a] * m[d] - m[b] * m[c]
    parts = [minor(4, 5, 7, 8), -minor(1, 2, 7, 8), minor(1, 2, 4, 5), -minor(3, 5, 6, 8), minor(0, 2, 6, 8), -minor(0, 2, 3, 5), minor(3, 4, 6, 7), -minor(0, 1, 6, 7), minor(0, 1, 3, 4)]
    size = m[0] * parts[0] + m[1] * parts[3] + m[2] * parts[6]
    return F.when(size != 0, F.array(*(p / size for p in parts)))


def carried(m: Column, x: Column, y: Column) -> Column:
    """[x, y] of a point after a map."""
    return F.array(m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5])


def against_scene(moves: DataFrame, wholes: DataFrame, keys: list[str], at: str) -> DataFrame:
    """moves with against: how far its second place lies from where the scene would have carried its first.

    A move has keys, frames i and j and places xi, yi, xj, yj. A frame that wholes (from composed) lacks takes the last one before it, and where there is none no motion.
    """
    still = F.array(*(F.lit(v) for v in EYE))
    x = moves.withColumn("_id", F.monotonically_increasing_id())
    ends = x.select(*keys, "_id", F.explode(F.array(F.struct(F.lit("i").alias("end"), F.col("i").cast("long").alias("f")), F.struct(F.lit("j").alias("end"), F.col("j").cast("long").alias("f")))).alias("_e"))
    asked = ends.select(*keys, F.col("_e.f").alias("_f"), F.lit(None).cast("array<double>").alias("_w")).distinct()
    known = wholes.select(*keys, F.col(at).cast("long").alias("_f"), F.col("whole").alias("_w"))
    w = Window.partitionBy(*keys).orderBy("_f").rangeBetween(Window.unboundedPreceding, 0)
    found = asked.unionByName(known).withColumn("_m", F.last("_w", ignorenulls=True).over(w)).filter("_w IS NULL").select(*keys, "_f", F.coalesce("_m", still).alias("_m"))
    for end in "ij":
        side = found.select(*(F.col(k).alias(f"_{end}{n}") for n, k in enumerate(keys)), F.col("_f").alias(f"_f{end}"), F.col("_m").alias(f"_m{end}"))
        x = x.join(side, [F.col(k).eqNullSafe(F.col(f"_{end}{n}")) for n, k in enumerate(keys)] + [F.col(end).cast("long") == F.col(f"_f{end}")], "left")
    moved = carried(product(F.coalesce("_mj", still), inverse(F.coalesce("_mi", still))), F.col("xi"), F.col("yi"))
    return x.withColumn("_p", moved).select(*moves.columns, F.sqrt(F.pow(F.col("xj") - F.col("_p")[0], 2) + F.pow(F.col("yj") - F.col("_p")[1], 2)).alias("against"))
