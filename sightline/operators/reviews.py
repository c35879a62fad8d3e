"""Review measures over tracks: scored episodes, contacts, jitter, pooled scores, scoreboards and even picks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.operators import scorecard
from sightline.operators.joins import interval_join


def score_episodes(df: DataFrame, keys: list[str], at: str, score: str, threshold: float = 1.0, max_gap: int = 0, shortest: int = 1) -> DataFrame:
    """keys, start, stop, peak, score: runs of steps whose score reaches the threshold, at most max_gap other steps between them.

    Both ends belong to the run, the peak is its first step of the largest score, which is given in thresholds. Runs
    shorter than shortest steps are left out.
    """
    w = Window.partitionBy(*keys).orderBy("_at")
    x = df.filter(F.col(score) >= threshold).groupBy(*keys, F.col(at).alias("_at")).agg(F.max(score).alias("_score"))
    x = x.withColumn("_new", F.coalesce((F.col("_at") - F.lag("_at").over(w) > max_gap + 1).cast("int"), F.lit(1)))
    x = x.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = x.groupBy(*keys, "_run").agg(
        F.min("_at").alias("start"), F.max("_at").alias("stop"), F.max_by("_at", F.struct("_score", -F.col("_at"))).alias("peak"), (F.max("_score") / threshold).alias("score")
    )
    return out.filter(F.col("stop") - F.col("start") + 1 >= shortest).drop("_run")


def contact_intervals(df: DataFrame, keys: list[str], at: str, state: str, flicker: int = 5) -> DataFrame:
    """keys, start, stop (exclusive), duration, closed, flicker: runs of consecutive true steps. A run is closed if the step after it was seen to be false; a missing or unknown step leaves it open."""
    w = Window.partitionBy(*keys).orderBy("_at")
    x = df.select(*keys, F.col(at).alias("_at"), F.col(state).alias("_s"))
    x = x.withColumn("_after", F.when(F.lead("_at").over(w) == F.col("_at") + 1, F.lead("_s").over(w))).filter("_s")
    x = x.withColumn("_new", F.coalesce((F.col("_at") - F.lag("_at").over(w) > 1).cast("int"), F.lit(1)))
    x = x.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = x.groupBy(*keys, "_run").agg(F.min("_at").alias("start"), (F.max("_at") + 1).alias("stop"), F.max_by("_after", "_at").alias("_after")).drop("_run")
    out = out.withColumn("duration", F.col("stop") - F.col("start")).withColumn("closed", F.coalesce(~F.col("_after"), F.lit(False)))
    return out.withColumn("flicker", F.col("duration") < flicker).drop("_after")


def nearest_previous(df: DataFrame, keys: list[str], at: str, item: str, value: str) -> DataFrame:
    """keys, at, item, moved: how far each row lies from the nearest row of the step before; null where that step has none.

    The nearest value stands next to it in the order of the step before, so both steps are sorted together and no pairs are made.
    """
    own = df.select(*keys, F.col(at).alias("_at"), F.col(item).alias("_item"), F.col(value).alias("_v"), F.lit(None).cast(df.schema[value].dataType).alias("_old"))
    old = df.select(*keys, (F.col(at) + 1).alias("_at"), F.lit(None).cast(df.schema[item].dataType).alias("_item"), F.col(value).alias("_v"), F.col(value).alias("_old")).withColumn("_o", F.lit(True))
    x = own.withColumn("_o", F.lit(False)).unionByName(old)
    up = Window.partitionBy(*keys, "_at").orderBy("_v", F.col("_o").desc()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, "_at").orderBy(F.col("_v").desc(), F.col("_o").desc()).rowsBetween(Window.unboundedPreceding, 0)
    below, above = F.last("_old", ignorenulls=True).over(up), F.last("_old", ignorenulls=True).over(down)
    x = x.withColumn("_b", below).withColumn("_a", above).filter("NOT _o")
    return x.select(*keys, F.col("_at").alias(at), F.col("_item").alias(item), F.least(F.col("_v") - F.col("_b"), F.col("_a") - F.col("_v")).alias("moved"))


def by_phase(df: DataFrame, phases: DataFrame, at: str, value: str, phase: str, start: str, stop: str, width: int) -> DataFrame:
    """phase, samples, median, p90, mean of the known values whose step lies in [start, stop); a phase without any has 0 and nulls."""
    x = interval_join(df.filter(F.col(value).isNotNull()).select(at, value), phases.select(phase, start, stop), [], at, start, stop, width)
    out = x.groupBy(phase).agg(F.count("*").alias("samples"), F.percentile(value, F.lit(0.5)).alias("median"), F.percentile(value, F.lit(0.9)).alias("p90"), F.avg(value).alias("mean"))
    return phases.select(phase).join(out, phase, "left").withColumn("samples", F.coalesce("samples", F.lit(0)))


def pooled_scores(df: DataFrame, group: str, score: str, truth: str) -> DataFrame:
    """group (null: all rows), positives, negatives, auroc, threshold, tp, fp, fn, tn: all rows together and each group, the groups judged at the best F1 threshold of all."""
    every = df.withColumn("_every", F.lit(0))
    cut = scorecard.best_f1(every, ["_every"], score, truth).select(F.col("threshold").alias("_cut"))
    both = F.array(F.struct(F.lit(True).alias("own"), F.col(group).alias("g")), F.struct(F.lit(False).alias("own"), F.lit(None).cast(df.schema[group].dataType).alias("g")))
    x = scorecard.known(df, score, truth).select(F.explode(both).alias("_k"), score, truth).join(F.broadcast(cut))  # cut is one row
    hit = F.col(score) >= F.col("_cut")
    cells = {"tp": hit & F.col(truth), "fp": hit & ~F.col(truth), "fn": ~hit & F.col(truth), "tn": ~hit & ~F.col(truth)}
    counts = x.groupBy("_k").agg(F.max("_cut").alias("threshold"), *(F.count(F.when(c, 1)).alias(n) for n, c in cells.items()))
    area = scorecard.auroc(x, ["_k"], score, truth)  # a struct is a join key even where the group is null
    return area.join(counts, "_k").select(F.col("_k.own").alias("per_group"), F.col("_k.g").alias(group), "positives", "negatives", "auroc", "threshold", *cells)


def scoreboard(measures: DataFrame, arm: str, view: str, views: list[str], measure: Callable[[Column], Column], name: str) -> DataFrame:
    """A row for each arm: the measure (an aggregate over the rows that a condition picks) pooled over all views and for each view, null where an arm has none."""
    return measures.groupBy(arm).agg(measure(F.lit(True)).alias(f"{name}_pooled"), *(measure(F.col(view) == v).alias(f"{name}_{v}") for v in views))


def evenly(df: DataFrame, keys: list[str], at: str, limit: int) -> DataFrame:
    """keys, at: at most limit of a key's distinct steps, evenly spread over their order with both ends."""
    w = Window.partitionBy(*keys)
    x = df.select(*keys, at).distinct().withColumn("_i", F.row_number().over(w.orderBy(at)) - 1).withColumn("_n", F.count("*").over(w))
    if limit < 2:
        return x.filter((F.col("_n") <= limit) | (F.col("_i") == 0)).select(*keys, at)
    places = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / (limit - 1)).cast("long"))
    return x.filter((F.col("_n") <= limit) | F.array_contains(places, F.col("_i").cast("long"))).select(*keys, at)


def spread(pool: np.ndarray, count: int, spacing: int, taken: tuple = ()) -> list[int]:
    """count steps at even quantiles of the pool, each the nearest that keeps its distance from all taken before."""
    pool = np.unique(pool)
    if not len(pool) or count <= 0:
        return []
    wanted = [len(pool) // 2] if count == 1 else [int(i * (len(pool) - 1) / (count - 1) + 0.5) for i in range(count)]
    free = np.ones(len(pool), bool)
    for t in taken:
        free &= np.abs(pool - t) >= spacing
    out: list[int] = []
    for target in pool[wanted]:
        if not free.any():
            break
        left = pool[free]
        out.append(int(left[np.abs(left - target).argmin()]))  # the first of equal ones is the smaller
        free &= np.abs(pool - out[-1]) >= spacing
    return out


def pick_spread(df: DataFrame, keys: list[str], at: str, count: int, spacing: int) -> DataFrame:
    """keys, at, place of the picks of each key, whose distinct steps meet in one task."""
    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), f"{at} long, place int"])

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        picks = spread(rows[at].to_numpy(), count, spacing)
        return pd.DataFrame({**{k: [rows[k].iloc[0]] * len(picks) for k in keys}, at: picks, "place": range(len(picks))})

    return df.select(*keys, F.col(at).cast("long").alias(at)).distinct().groupBy(*keys).applyInPandas(one, schema)


def between_boxes(df: DataFrame, keys: list[str], at: str, box: str, score: str, same: Column) -> DataFrame:
    """keys, at, box, score: what lies strictly between two consecutive boxes of a key that are the same thing (a condition over _a and _b), drawn linearly."""
    w = Window.partitionBy(*keys).orderBy(at)
    x = df.select(*keys, F.col(at).alias("_t"), F.col(box).alias("_a"), F.col(score).alias("_s"), F.lead(at).over(w).alias("_u"), F.lead(box).over(w).alias("_b"), F.lead(score).over(w).alias("_z"))
    x = x.filter((F.col("_u") - F.col("_t") > 1) & same).withColumn(at, F.explode(F.sequence(F.col("_t") + 1, F.col("_u") - 1)))
    part = (F.col(at) - F.col("_t")) / (F.col("_u") - F.col("_t"))
    drawn = F.zip_with("_a", "_b", lambda p, q: (1 - part) * p + part * q)
    return x.select(*keys, at, drawn.alias(box), ((1 - part) * F.col("_s") + part * F.col("_z")).alias(score))


def merge_fragments(rows: pd.DataFrame, gap: int, least: float) -> pd.DataFrame:
    """rows (piece, first, last, a0..a3 and z0..z3, the first and last boxes) with object: a piece goes to the best-overlapping object that ended at most gap steps before it began."""
    from sightline.operators.matching import iou

    rows = rows.sort_values(["first", "piece"]).reset_index(drop=True)
    start, end = rows[["a0", "a1", "a2", "a3"]].to_numpy(float), rows[["z0", "z1", "z2", "z3"]].to_numpy(float)
    first, last, made = rows["first"].to_numpy(), rows["last"].to_numpy().copy(), np.zeros(len(rows), int)
    open_: list[tuple[int, int]] = []  # object, its last piece
    for i in range(len(rows)):
        open_ = [(o, p) for o, p in open_ if first[i] - last[p] <= gap]
        reach = [(o, p) for o, p in open_ if first[i] > last[p]]
        share = iou(end[[p for _, p in reach]], start[i : i + 1])[:, 0] if reach else np.zeros(0)
        best = max(((s, last[p] - first[i], -k) for k, (s, (_, p)) in enumerate(zip(share, reach)) if s >= least), default=None)
        made[i] = reach[-best[2]][0] if best else i
        open_ = [(o, p) for o, p in open_ if o != made[i]] + [(int(made[i]), i)]
    return rows.assign(object=rows["piece"].to_numpy()[made] if len(rows) else [])
