"""Sequential folds over ordered rows: debounce, hysteresis, decayed evidence, smoothing and dynamic programming.

Folds that SQL can tell run as aggregate() over the ordered array of one key; the rest are functions over one
key's rows for applyInPandas. A key's rows meet in one task, as their order asks for.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered(df: DataFrame, keys: list[str], order: str, *values: str) -> DataFrame:
    """keys, rows: array of (order, values...) in order."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *values))).alias("rows"))


def debounce(df: DataFrame, keys: list[str], order: str, value: str, on: int = 2, off: int = 3) -> DataFrame:
    """keys, order, state: true after on trues in a row, false after off falses; a null resets and gives null."""
    empty = F.struct(F.lit(False).alias("state"), F.lit(0).alias("t"), F.lit(0).alias("f"), F.array().cast("array<boolean>").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        v = row[value]
        t = F.when(v, acc["t"] + 1).otherwise(0)
        f = F.when(~v, acc["f"] + 1).otherwise(0)
        state = F.when(v.isNull(), False).when(acc["state"], ~(f >= off)).otherwise(t >= on)
        return F.struct(state.alias("state"), t.cast("int").alias("t"), f.cast("int").alias("f"), F.concat(acc["out"], F.array(F.when(v.isNotNull(), state))).alias("out"))

    x = ordered(df, keys, order, value).withColumn("out", F.aggregate("rows", empty, step)["out"])
    return x.select(*keys, F.explode(F.arrays_zip(F.col(f"rows.{order}").alias(order), F.col("out").alias("state"))).alias("_x")).select(*keys, f"_x.{order}", "_x.state")


def decayed_sum(df: DataFrame, keys: list[str], order: str, value: str, half_life: float) -> DataFrame:
    """keys, total, last: evidence that halves every half_life steps, added in order."""
    rate = math.log(0.5) / half_life
    empty = F.struct(F.lit(0.0).alias("total"), F.lit(None).cast("long").alias("at"))

    def step(acc: Column, row: Column) -> Column:
        kept = F.when(acc["at"].isNull(), 0.0).otherwise(acc["total"] * F.exp(F.lit(rate) * (row[order] - acc["at"])))
        return F.struct((kept + F.coalesce(row[value], F.lit(0.0))).alias("total"), row[order].alias("at"))

    x = ordered(df, keys, order, value).withColumn("x", F.aggregate("rows", empty, step))
    return x.select(*keys, F.col("x.total").alias("total"), F.col("x.at").alias("last"))


def hysteresis(values: np.ndarray, enter: float, leave: float, dwell: int) -> list[tuple[int, int]]:
    """(first, last) of events: entered after dwell values at or below enter, left after dwell at or above leave; ends are dated back to the first of the dwell."""
    out, inside, run, start = [], False, 0, 0
    for i, v in enumerate(values):
        hit = (v >= leave) if inside else (v <= enter)
        run = run + 1 if hit else 0
        if run == dwell:
            if inside:
                out.append((start, i - dwell))
            else:
                start = i - dwell + 1
            inside, run = not inside, 0
    if inside:
        out.append((start, len(values) - 1))
    return out


def hysteresis_events(df: DataFrame, keys: list[str], order: str, value: str, enter: float, leave: float, dwell: int = 3) -> DataFrame:
    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), "first long, last long"])

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        at = rows[order].to_numpy()
        found = hysteresis(rows[value].to_numpy(float), enter, leave, dwell)
        return pd.DataFrame({**{k: [rows[k].iloc[0]] * len(found) for k in keys}, "first": [at[a] for a, _ in found], "last": [at[b] for _, b in found]})

    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(one, schema)


def one_euro(values: np.ndarray, at: np.ndarray, least: float = 1.0, beta: float = 0.007, derivative: float = 1.0) -> np.ndarray:
    """The One-Euro filter: smoothing whose cut-off rises with speed."""

    def share(cut: float, dt: float) -> float:
        r = 2 * math.pi * cut * dt
        return r / (r + 1)

    out = np.array(values, float)
    speed = 0.0
    for i in range(1, len(out)):
        dt = max(float(at[i] - at[i - 1]), 1e-9)
        a = share(derivative, dt)
        speed = a * (values[i] - out[i - 1]) / dt + (1 - a) * speed
        a = share(least + beta * abs(speed), dt)
        out[i] = a * values[i] + (1 - a) * out[i - 1]
    return out


def smooth(df: DataFrame, keys: list[str], order: str, value: str, **options: float) -> DataFrame:
    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), f"{order} long, {value} double, smoothed double"])

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        return rows.assign(smoothed=one_euro(rows[value].to_numpy(float), rows[order].to_numpy(float), **options))

    return df.select(*keys, F.col(order).cast("long").alias(order), F.col(value).cast("double").alias(value)).groupBy(*keys).applyInPandas(one, schema)


def monotonic_path(scores: np.ndarray, stay: float = -0.02, advance: float = 0.0, free_start: bool = True) -> np.ndarray:
    """The step of each sample, never falling, with the largest total score; staying costs stay, moving on earns advance.

    With free_start the first sample may be at any step; else it is at a later step only where its score
    there beats what the step before gives.
    """
    n, m = scores.shape
    best = np.full((n, m), -np.inf)
    back = np.zeros((n, m), int)
    best[0] = scores[0]
    if not free_start:
        for j in range(1, m):
            if scores[0, j] <= best[0, j - 1] + stay + advance:
                best[0, j] = -np.inf
    for i in range(1, n):
        held = best[i - 1] + stay
        moved = np.append(-np.inf, best[i - 1][:-1] + advance)
        back[i] = np.where(moved > held, np.arange(m) - 1, np.arange(m))
        best[i] = scores[i] + np.maximum(held, moved)
    path = [int(np.argmax(best[-1]))]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i, path[-1]]))
    return np.array(path[::-1])


def drop_dtw(cost: np.ndarray, drop) -> tuple[float, list[tuple[int, int]]]:
    """Least cost of matching rows to columns in order, where any row may be dropped for drop (one value, or one for each row); every column takes at least one row if it can."""
    n, m = cost.shape
    drop = np.broadcast_to(np.asarray(drop, float), (n,))
    best = np.full((n + 1, m + 1), np.inf)
    best[0, 0] = 0.0
    best[1:, 0] = np.cumsum(drop)
    move = np.zeros((n + 1, m + 1), int)
    for i in range(1, n + 1):
        before = best[i - 1]
        options = np.stack([before[1:] + drop[i - 1], before[:-1] + cost[i - 1], before[1:] + cost[i - 1]])
        move[i, 1:] = options.argmin(axis=0)
        best[i, 1:] = options.min(axis=0)
    pairs, i, j = [], n, m
    while i and j:
        if move[i, j]:
            pairs.append((i - 1, j - 1))
        j -= move[i, j] == 1
        i -= 1
    return float(best[n, m]), pairs[::-1]


def memory_gate(rows: pd.DataFrame, score: str, overlap: str, contested: str, area: str, least_score: float = 0.5, least_overlap: float = 0.6, most_contested: float = 0.3, warm: int = 3, jump: float = 2.0) -> list[str]:
    """The first reason against trusting each row, or ok. The area history that a jump is measured against takes trusted rows only."""
    history: list[float] = []
    out = []
    for s, o, c, a in rows[[score, overlap, contested, area]].itertuples(index=False):
        middle = float(np.median(history[-15:])) if history else None
        if not s >= least_score:
            reason = "low_score"
        elif not o >= least_overlap:
            reason = "low_overlap"
        elif c > most_contested:
            reason = "contested"
        elif len(history) < warm:
            reason = "warmup"
        elif middle and not (1 / jump <= a / middle <= jump):
            reason = "area_jump"
        else:
            reason = "ok"
        if reason in ("ok", "warmup"):
            history.append(float(a))
        out.append(reason)
    return out


def gated(df: DataFrame, keys: list[str], order: str, score: str, overlap: str, contested: str, area: str, **limits: float) -> DataFrame:
    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), f"{order} long, reason string"])

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        return rows[[*keys, order]].assign(reason=memory_gate(rows, score, overlap, contested, area, **limits))

    return df.select(*keys, order, score, overlap, contested, area).groupBy(*keys).applyInPandas(one, schema)
