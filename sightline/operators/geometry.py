"""Numerical geometry over small groups: triangulation, line fits, robust outlier views, box fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def triangulate(cameras: np.ndarray, points: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """The point whose projections by 3x4 cameras come nearest to points, by the direct linear transform."""
    w = np.ones(len(points)) if weights is None else weights
    rows = [w[i] * (points[i][k] * cameras[i][2] - cameras[i][k]) for i in range(len(points)) for k in (0, 1)]
    x = np.linalg.svd(np.array(rows))[2][-1]
    return x[:3] / x[3]


def project(camera: np.ndarray, point: np.ndarray) -> np.ndarray:
    x = camera @ np.append(point, 1.0)
    return x[:2] / x[2]


def residuals(cameras: np.ndarray, points: np.ndarray, found: np.ndarray) -> np.ndarray:
    return np.array([np.linalg.norm(project(c, found) - p) for c, p in zip(cameras, points)])


def without_outlier(cameras: np.ndarray, points: np.ndarray, most: float) -> tuple[np.ndarray, list[int]]:
    """Triangulate; while the worst residual is above most and over two views are left, drop the view whose removal leaves the smallest worst residual."""
    kept = list(range(len(points)))
    found = triangulate(cameras, points)
    while len(kept) > 2 and residuals(cameras[kept], points[kept], found).max() > most:
        tries = []
        for drop in kept:
            rest = [k for k in kept if k != drop]
            x = triangulate(cameras[rest], points[rest])
            tries.append((residuals(cameras[rest], points[rest], x).max(), drop, x))
        _, drop, found = min(tries, key=lambda t: (t[0], t[1]))
        kept.remove(drop)
    return found, kept


def fit_line(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """centre, unit direction and root-mean-square distance of the best line."""
    centre = points.mean(axis=0)
    _, s, vt = np.linalg.svd(points - centre)
    return centre, vt[0], float(np.sqrt((s[1:] ** 2).sum() / len(points)))


def triangulated(df: DataFrame, keys: list[str], most: float = 15.0) -> DataFrame:
    """keys, x, y, z, views, worst: rows hold camera (array of 12, row by row), u, v and view. Fewer than two views give no row.

    A group's rows, no more than there are views, meet by its keys; a task works through an Arrow batch of groups at a time.
    """
    names = [*keys, "x", "y", "z", "views", "worst"]
    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), "x double, y double, z double, views int, worst double"])

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for i, rows in enumerate(x["_seen"]):
                cameras = np.stack([r["camera"] for r in rows]).astype(float).reshape(-1, 3, 4)
                points = np.array([[r["u"], r["v"]] for r in rows], float)
                found, kept = without_outlier(cameras, points, most)
                out.append((*x[keys].iloc[i], *found, len(kept), residuals(cameras[kept], points[kept], found).max()))
            yield pd.DataFrame(out, columns=names)

    x = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("view", "camera", "u", "v"))).alias("_seen"))
    return x.filter(F.size("_seen") >= 2).mapInPandas(go, schema)


def fuse_boxes(boxes: np.ndarray, scores: np.ndarray, least: float = 0.55) -> list[tuple[np.ndarray, float]]:
    """Boxes by falling score join the first cluster whose fused box they overlap enough; a fused box is the score-weighted mean."""
    from sightline.operators.matching import iou

    clusters: list[list[int]] = []
    fused: list[np.ndarray] = []
    for i in np.lexsort((np.arange(len(scores)), -scores)):
        near = [k for k, f in enumerate(fused) if iou(f[None], boxes[i][None])[0, 0] >= least]
        k = near[0] if near else len(clusters)
        if not near:
            clusters.append([])
            fused.append(boxes[i])
        clusters[k].append(int(i))
        w = scores[clusters[k]]
        fused[k] = (boxes[clusters[k]] * w[:, None]).sum(axis=0) / w.sum()
    return [(f, float(scores[c].mean())) for f, c in zip(fused, clusters)]
