"""Regions: connected pixels of masks in run-length rows, hulls that masks of several views carve out of a grid, and footprints of boxes on a plane.

A mask's runs are an array of (row, first, last), in order and apart from each other. Runs of all masks of an Arrow batch are
linked and labelled together in numpy. A hull looks at a grid from coarse to fine: a cell is cut into eight only where its image still
meets every view's mask, which summed-area tables answer for any rectangle of pixels at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators.poses import _typed

RUN = "array<struct<row:long,first:long,last:long>>"


def runs_of(mask: Column, width: int) -> Column:
    """The runs of distinct pixel numbers (row * width + column); null for a missing mask."""
    p = F.array_sort(mask)
    one = lambda x: F.struct(F.floor(x / width).alias("row"), F.pmod(x, F.lit(width)).alias("first"), F.pmod(x, F.lit(width)).alias("last"))
    begins = F.filter(p, lambda x: (F.pmod(x, F.lit(width)) == 0) | ~F.array_contains(mask, x - 1))
    ends = F.filter(p, lambda x: (F.pmod(x, F.lit(width)) == width - 1) | ~F.array_contains(mask, x + 1))
    return F.zip_with(begins, ends, lambda a, b: F.struct(one(a)["row"].cast("long").alias("row"), one(a)["first"].cast("long").alias("first"), one(b)["last"].cast("long").alias("last")))


def pixels_of(runs: Column, width: int) -> Column:
    """Pixel numbers of runs, in order."""
    return F.flatten(F.transform(runs, lambda r: F.sequence(r["row"] * width + r["first"], r["row"] * width + r["last"])))


def labels(mask: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """For each run the number of the first run that it is connected with. Runs are in order of mask, row and first."""
    n = len(mask)
    label = np.arange(n)
    if not n:
        return label
    reach, wide = int(diagonal), int(last.max()) + 3
    line = mask * (int(row.max()) + 2) + row
    starts, stops = line * wide + first + 1, line * wide + last + 1
    low = np.searchsorted(stops, (line + 1) * wide + first + 1 - reach)  # runs of the next row that touch stand together
    high = np.searchsorted(starts, (line + 1) * wide + last + 1 + reach, "right")
    count = np.maximum(high - low, 0)
    a = np.repeat(np.arange(n), count)
    b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    while len(a):
        np.minimum.at(label, label[a], label[b])
        np.minimum.at(label, label[b], label[a])
        while not np.array_equal(label, label[label]):
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def kept_components(df: DataFrame, runs: str, share: float = 0.1, diagonal: bool = True) -> DataFrame:
    """df with kept (the runs of components with at least that share of the largest one's pixels), components and dropped (pixels that go).

    Pixels touch at sides and, with diagonal, corners. A missing mask stays null with 0 components; an empty one is kept empty.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(runs)
            size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten()  # skips what null rows may hold
            row, first, last = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("row", "first", "last"))
            mask = np.repeat(np.arange(len(size)), size)
            label = labels(mask, row, first, last, diagonal)
            area = np.bincount(label, weights=last - first + 1, minlength=len(label)).astype(np.int64)
            most = np.zeros(len(size), np.int64)
            np.maximum.at(most, mask, area[label])
            keep = area[label] >= share * most[mask]
            left = np.bincount(mask[keep], minlength=len(size))
            gone = np.bincount(mask[~keep], weights=(last - first + 1)[~keep], minlength=len(size)).astype(np.int64)
            found = np.bincount(mask[label == np.arange(len(label))], minlength=len(size)).astype(np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(left)]).astype(np.int32), mask=np.append(column.is_null().to_numpy(zero_copy_only=False), False))
            kept = pa.ListArray.from_arrays(offsets, flat.filter(pa.array(keep)))
            yield pa.RecordBatch.from_arrays([*batch.columns, kept, pa.array(found), pa.array(gone)], names=[*batch.schema.names, "kept", "components", "dropped"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(go, f"{schema}, kept {df.schema[runs].dataType.simpleString()}, components long, dropped long")


# ---- hulls


def _sums(pixels, width: int, height: int) -> np.ndarray:
    """The summed-area table of a mask."""
    image = np.zeros((height, width), np.int64)
    image.reshape(-1)[np.asarray(pixels, np.int64)] = 1
    out = np.zeros((height + 1, width + 1), np.int64)
    out[1:, 1:] = image.cumsum(0).cumsum(1)
    return out


def _met(table: np.ndarray, camera: np.ndarray, low: np.ndarray, size: float) -> np.ndarray:
    """Whether the image of each cell, a cube from low on, may meet the mask. A cube that reaches behind the camera may."""
    corner = np.array([[i, j, k] for i in (0, 1) for j in (0, 1) for k in (0, 1)]) * size
    x = (low[:, None] + corner) @ camera[:, :3].T + camera[:, 3]
    ahead = x[..., 2] > 1e-9
    pixel = np.where(ahead[..., None], x[..., :2] / np.where(ahead, x[..., 2], 1.0)[..., None], 0.0)
    height, width = np.array(table.shape) - 1
    a = np.clip(np.floor(pixel.min(1)), 0, [width, height]).astype(int)
    b = np.clip(np.floor(pixel.max(1)) + 1, 0, [width, height]).astype(int)
    some = table[b[:, 1], b[:, 0]] - table[a[:, 1], b[:, 0]] - table[b[:, 1], a[:, 0]] + table[a[:, 1], a[:, 0]] > 0
    some &= (b > a).all(1)
    return np.where(ahead.all(1), some, ahead.any(1))


def _holds(table: np.ndarray, camera: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Whether each centre's pixel is in the mask."""
    x = centre @ camera[:, :3].T + camera[:, 3]
    ahead = x[:, 2] > 1e-9
    height, width = np.array(table.shape) - 1
    p = np.floor(np.where(ahead[:, None], x[:, :2] / np.where(ahead, x[:, 2], 1.0)[:, None], -1.0))
    inside = ahead & (p >= 0).all(1) & (p < [width, height]).all(1)
    c, r = np.where(inside[:, None], p, 0).astype(int).T
    return inside & (table[r + 1, c + 1] - table[r, c + 1] - table[r + 1, c] + table[r, c] > 0)


def carved(tables: list[np.ndarray], cameras: list[np.ndarray], origin: np.ndarray, cell: float, levels: int, lot: int = 1 << 15) -> tuple[list[np.ndarray], int]:
    """Lots of the numbers (x, y, z) of cells whose centre is in every mask, of a cube with 2**levels cells a side, and how many cells of any size were looked at."""
    found, seen, stack = [], 0, [(levels, np.zeros((1, 3), np.int64))]
    eight = np.array([[i, j, k] for i in (0, 1) for j in (0, 1) for k in (0, 1)])
    while stack:  # depth first and in lots, so what waits is never more than a few lots a level
        level, cells = stack.pop()
        size = cell * 2**level
        for table, camera in zip(tables, cameras):
            seen += len(cells)
            low = origin + cells * size
            cells = cells[_met(table, camera, low, size) if level else _holds(table, camera, low + size / 2)]
        if level:
            below = (cells[:, None] * 2 + eight).reshape(-1, 3)
            stack += [(level - 1, below[a : a + lot]) for a in range(0, len(below), lot)]
        elif len(cells):
            found.append(cells)
    return found, seen


def hulls(df: DataFrame, keys: list[str], origin: tuple[float, float, float], cell: float, levels: int, cells: bool = True) -> DataFrame:
    """keys, x, y, z of the cells that lie in every view's mask; with cells=False keys, cells (how many), looked_at and views.

    df has a row for each view of a moment: camera (3x4, row by row), width, height and pixels (distinct pixel numbers). A view without a camera or mask doesn't carve; a
    moment without any view has no row, one whose masks share nothing no cell. A task holds one moment's masks and a few lots of cells.
    """
    w = df.where(F.col("camera").isNotNull() & F.col("pixels").isNotNull()).groupBy(*keys).agg(F.collect_list(F.struct("camera", "width", "height", "pixels")).alias("_views"))

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for i in range(len(x)):
                views = x["_views"].iloc[i]
                own = x[keys].iloc[[i]].reset_index(drop=True)
                found, seen = carved([_sums(v["pixels"], v["width"], v["height"]) for v in views], [np.asarray(v["camera"], float).reshape(3, 4) for v in views], np.asarray(origin, float), cell, levels)
                if not cells:
                    yield own.assign(cells=sum(map(len, found)), looked_at=seen, views=len(views))
                for lot in found if cells else []:
                    yield own.loc[np.zeros(len(lot), int)].reset_index(drop=True).assign(x=lot[:, 0], y=lot[:, 1], z=lot[:, 2])

    return w.mapInPandas(go, _typed(df, keys) + ("x long, y long, z long" if cells else "cells long, looked_at long, views long"))


def stable_boxes(df: DataFrame, keys: list[str], view: str, box: str, least: int = 10, spread: float = 0.5) -> DataFrame:
    """keys, view, box: the median box (x1, y1, x2, y2) of each view that sees its thing rest: the middle half of its centres spans under so many box sizes both ways."""
    b = lambda i: F.col(box)[i].cast("double")
    middle = lambda i: (b(i) + b(i + 2)) / 2
    at = lambda c, q: F.percentile(c, F.lit(q))
    x = df.where(F.col(box).isNotNull()).groupBy(*keys, view).agg(
        F.count("*").alias("_n"), F.array(*(at(b(i), 0.5) for i in range(4))).alias("box"), *((at(middle(i), 0.75) - at(middle(i), 0.25)).alias(f"_iqr{i}") for i in (0, 1))
    )
    steady = [F.col(f"_iqr{i}") < spread * (F.col("box")[i + 2] - F.col("box")[i]) for i in (0, 1)]
    return x.where((F.col("_n") >= least) & steady[0] & steady[1]).select(*keys, view, "box")


def footprints(boxes: DataFrame, keys: list[str], half: float, cell: float, views: int = 3, seed: str | None = None) -> DataFrame:
    """keys, cells, runs (row, first, last: cells of the plane z = 0), bounds (x1, y1, x2, y2), centre: where a thing may stand, as all its views' boxes hold it.

    boxes has a row for each view: camera (3x4) and box; the plane is cut into cells over 2 * half. Of several components the one stays that holds seed, a
    column with a point (x, y), or else the largest, then the first. A key with fewer views, or whose boxes share no cell, has no row.
    """
    known = F.max(seed) if seed else F.lit(None).cast("array<double>")
    w = boxes.groupBy(*keys).agg(F.collect_list(F.struct("camera", "box")).alias("_views"), known.alias("_seed")).where(F.size("_views") >= views)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = int(round(2 * half / cell))
        at = -half + (np.arange(n) + 0.5) * (2 * half / n)
        for x in batches:
            rows = []
            for i in range(len(x)):
                inside = np.ones((n, n), bool)
                for v in x["_views"].iloc[i]:
                    c, b = np.asarray(v["camera"], float).reshape(3, 4), v["box"]
                    p = [c[k, 0] * at[None, :] + c[k, 1] * at[:, None] + c[k, 3] for k in range(3)]
                    ahead = p[2] > 0
                    u, t = (np.where(ahead, p[k] / np.where(ahead, p[2], 1.0), np.nan) for k in (0, 1))
                    inside &= (u >= b[0]) & (u <= b[2]) & (t >= b[1]) & (t <= b[3])
                edge = np.diff(np.pad(inside.astype(np.int8), ((0, 0), (1, 1))), axis=1)
                row, first = np.nonzero(edge == 1)
                last = np.nonzero(edge == -1)[1] - 1
                if not len(row):
                    continue
                label = labels(np.zeros(len(row), np.int64), row, first, last, diagonal=False)
                area = np.bincount(label, weights=last - first + 1)
                best, s = int(area.argmax()), x["_seed"].iloc[i]
                if s is not None:
                    r, k = (int(np.floor((s[j] + half) / (2 * half / n))) for j in (1, 0))
                    holds = np.flatnonzero((row == r) & (first <= k) & (k <= last))
                    best = int(label[holds[0]]) if len(holds) else best
                row, first, last = (z[label == best] for z in (row, first, last))
                size = last - first + 1
                step = 2 * half / n
                bounds = [-half + first.min() * step, -half + row.min() * step, -half + (last.max() + 1) * step, -half + (row.max() + 1) * step]
                middle = [float(((at[first] + at[last]) / 2 * size).sum() / size.sum()), float((at[row] * size).sum() / size.sum())]
                rows.append((*x[keys].iloc[i], int(size.sum()), [dict(row=int(a), first=int(b), last=int(c)) for a, b, c in zip(row, first, last)], [float(z) for z in bounds], middle))
            yield pd.DataFrame(rows, columns=[*keys, "cells", "runs", "bounds", "centre"])

    return w.mapInPandas(go, _typed(boxes, keys) + f"cells long, runs {RUN}, bounds array<double>, centre array<double>")
