"""The best combination of candidates over views: at most one a view, all of one place, with the most evidence together.

The search takes views one after another, best candidates first, and leaves a branch as soon as what it has and the best that is left can't beat what was found. A
combination carries the sum of its candidates' equations, so one more candidate is one addition and one 4x4 eigenvector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.poses import _typed


def _rows(camera: np.ndarray, u: float, v: float) -> np.ndarray:
    """The products of the two equations that a pixel adds, on pixels' scale."""
    a, b = u * camera[2] - camera[0], v * camera[2] - camera[1]
    return np.outer(a, a) + np.outer(b, b)


def _place(m: np.ndarray) -> np.ndarray | None:
    x = np.linalg.eigh(m)[1][:, 0]
    return x[:3] / x[3] if abs(x[3]) > 1e-12 else None


def _away(camera: np.ndarray, place: np.ndarray, u: float, v: float) -> float:
    x = camera[:, :3] @ place + camera[:, 3]
    return float(np.hypot(x[0] / x[2] - u, x[1] / x[2] - v)) if x[2] > 1e-9 else np.inf


class Candidates:
    """views: lists of (score, name, camera, u, v, size), by falling score."""

    def __init__(self, views: list[list[tuple]], gate: float, band: tuple[float, float], least: int):
        self.views = sorted(views, key=lambda v: -v[0][0])
        self.gate, self.band, self.least = gate, band, least
        self.best_left = np.append(np.cumsum([max(v[0][0], 0.0) for v in self.views][::-1])[::-1], 0.0)
        self.agree: dict[tuple, bool] = {}
        self.looked_at = 0

    def pair(self, a: tuple, b: tuple) -> bool:
        """Whether the place of two candidates is within the gate of both and their sizes within the band of each other."""
        key = (a[1], b[1])
        if key not in self.agree:
            self.looked_at += 1
            at = _place(_rows(*a[2:5]) + _rows(*b[2:5]))
            low, high = sorted((a[5], b[5]))
            self.agree[key] = at is not None and max(_away(c[2], at, c[3], c[4]) for c in (a, b)) <= self.gate and self.band[0] * high <= low and high <= self.band[1] * low
        return self.agree[key]

    def whole(self, chosen: list[tuple]) -> np.ndarray | None:
        """The place of a combination if every view is within the gate of it."""
        self.looked_at += 1
        at = _place(sum(_rows(*c[2:5]) for c in chosen))
        return at if at is not None and max(_away(c[2], at, c[3], c[4]) for c in chosen) <= self.gate else None

    def search(self) -> tuple | None:
        """(score, chosen, place) of the most evidence; ties go to more views, then to the first names."""
        best: tuple | None = None

        def rank(score: float, chosen: list[tuple]) -> tuple:
            return (-score, -len(chosen), sorted(c[1] for c in chosen))

        def go(k: int, score: float, chosen: list[tuple]) -> None:
            nonlocal best
            if len(chosen) + len(self.views) - k < self.least or (best and score + self.best_left[k] < best[0] - 1e-12):
                return
            if k == len(self.views):
                if best is None or rank(score, chosen) < rank(*best[:2]):
                    at = self.whole(chosen)
                    if at is not None:
                        best = (score, list(chosen), at)
                return
            for c in self.views[k]:
                if all(self.pair(b, c) for b in chosen):
                    go(k + 1, score + c[0], [*chosen, c])
            go(k + 1, score, chosen)

        go(0, 0.0, [])
        return best


def best_combinations(df: DataFrame, keys: list[str], gate: float = 30.0, most: int = 8, least: int = 3, band: tuple[float, float] = (0.5, 2.0)) -> DataFrame:
    """keys, score, x, y, z, names (of the chosen candidates, sorted), looked_at (fits made): the combination with the largest sum of scores.

    df has view, name (unique in its key), camera (3x4, row by row), u, v, score and size, one row a candidate; of a view the ``most`` best by score, then name, count.
    Every two chosen candidates must meet within the gate (pixels) and their sizes differ by no more than the band; so must all together. A key
    without such a combination of at least ``least`` views has no row. Rows that lack a value don't count.
    """
    needed = ["view", "name", "camera", "u", "v", "score", "size"]
    whole = df.where(" AND ".join(f"{c} IS NOT NULL" for c in needed)).select(*keys, *needed)
    w = Window.partitionBy(*keys, "view").orderBy(F.col("score").desc(), "name")
    top = whole.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)  # so a group has a few rows for each view of the rig
    x = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("view", "_n", *needed[1:]))).alias("_all"))

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, rows in enumerate(b["_all"]):
                views: dict = {}
                for r in rows:
                    views.setdefault(r["view"], []).append((float(r["score"]), r["name"], np.asarray(r["camera"], float).reshape(3, 4), float(r["u"]), float(r["v"]), float(r["size"])))
                search = Candidates(list(views.values()), gate, band, least)
                found = search.search() if len(views) >= least else None
                if found:
                    out.append((*b[keys].iloc[i], found[0], *map(float, found[2]), sorted(c[1] for c in found[1]), search.looked_at))
            yield pd.DataFrame(out, columns=[*keys, "score", "x", "y", "z", "names", "looked_at"])

    kind = df.schema["name"].dataType.simpleString()
    return x.mapInPandas(go, _typed(df, keys) + f"score double, x double, y double, z double, names array<{kind}>, looked_at long")
