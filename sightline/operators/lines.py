"""Lines in space from what several views see of them: planes of elongated views, rays of compact ones.

A group is one thing at one moment; each view gives it one row, so a group is no larger than the rig. Spark brings a group's rows together
and numpy fits all groups of a batch at once: a plane or ray adds its products to its group's sums, a view left out is taken
away from them, and a fit is the smallest eigenvector of one 3x3 matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.cameras import Camera, straightened

#: What a row holds besides its keys and view. one and other are the axis ends, middle the centre, each at depth 1 with the lens's bend taken out.
FIELDS = {"lens": 2, "turn": 9, "centre": 3, "one": 2, "other": 2, "middle": 2}


@dataclass(frozen=True)
class Rules:
    """gate: most pixels between a view and the line; angle: least degrees between two planes; length: of the thing, if known; tolerance: what an end may lack;
    merged: how many lengths one view, or all, may span; gap: most length between two views' stretches."""

    gate: float = 12.0
    angle: float = 10.0
    length: float | None = None
    tolerance: float = 1.0
    merged: float = 1.5
    gap: float = 5.0


def observed(camera: Camera, one: Column, other: Column, middle: Column) -> list[Column]:
    """The columns of FIELDS from raw pixels; null ends make a compact view."""
    at = {"one": one, "other": other, "middle": middle}
    return [F.array(camera.lens[0], camera.lens[1]).alias("lens"), camera.turn.alias("turn"), camera.centre.alias("centre"), *(F.when(p.isNotNull(), straightened(camera, p)).alias(n) for n, p in at.items())]


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


class Views:
    """Arrays of all groups of a batch, padded to the most views: group, view, then coordinates."""

    def __init__(self, groups: list[list[dict]]):
        most = max(map(len, groups))
        shape = (len(groups), most)
        self.names = [[v["view"] for v in g] for g in groups]
        raw = {n: np.full((*shape, size), np.nan) for n, size in FIELDS.items()}
        self.weight, self.there = np.zeros(shape), np.zeros(shape, bool)
        for i, g in enumerate(groups):
            for k, v in enumerate(g):
                self.there[i, k], self.weight[i, k] = True, v["weight"]
                for n in FIELDS:
                    if v[n] is not None and not any(x is None for x in v[n]):
                        raw[n][i, k] = v[n]
        self.lens, self.centre, self.turn = raw["lens"], raw["centre"], raw["turn"].reshape(*shape, 3, 3)
        self.straight = {n: np.concatenate([raw[n], np.ones((*shape, 1))], -1) for n in ("one", "other", "middle")}
        self.ray = {n: _unit(np.einsum("gvji,gvj->gvi", self.turn, x)) for n, x in self.straight.items()}
        across = np.cross(self.ray["one"], self.ray["other"])
        self.plane = self.there & (np.linalg.norm(across, axis=-1) >= 1e-9)  # false for NaN
        self.point = self.there & ~self.plane & np.isfinite(self.ray["middle"]).all(axis=-1)
        self.normal = np.where(self.plane[..., None], _unit(np.nan_to_num(across)), 0.0)
        self.offset = np.where(self.plane, (self.normal * np.nan_to_num(self.centre)).sum(-1), 0.0)


class Lines:
    """One line for each group: at, along, condition; known is false where the kept views give none."""

    def __init__(self, views: Views, kept: np.ndarray, rules: Rules):
        self.views, self.kept, self.rules = views, kept, rules
        planes, rays = kept & views.plane, kept & views.point
        self.at, self.along = np.zeros((len(kept), 3)), np.zeros((len(kept), 3))
        self.condition = np.zeros(len(kept))
        n, w = views.normal, np.where(planes, views.weight, 0.0)
        several = planes.sum(1) >= 2
        cosine = np.abs(np.einsum("gvi,gui->gvu", n, n))
        pairs = planes[:, :, None] & planes[:, None, :]
        widest = np.degrees(np.arccos(np.clip(np.where(pairs, cosine, 1.0).min(axis=(1, 2)), 0, 1)))
        self.known = several & (widest >= rules.angle)
        # A plane counts by the sine of its angle to the others as well: what its normal lacks in the sum of all normals' products.
        total, own = w.sum(1, keepdims=True), np.einsum("gv,gvi,gvj->gij", w, n, n)
        lacks = np.clip(total - np.einsum("gvi,gij,gvj->gv", n, own, n), 0, None)
        factor = np.divide(lacks, total - w, out=np.zeros_like(lacks), where=total - w > 0)
        value, vector = np.linalg.eigh(np.einsum("gv,gvi,gvj->gij", np.where(planes, w * w * factor, 0.0), n, n))
        self.along = vector[:, :, 0]
        self.condition = np.sqrt(np.divide(np.clip(value[:, 1], 0, None), value[:, 2], out=np.zeros(len(value)), where=value[:, 2] > 0))
        # Seen along the line, planes and rays alike are lines in a plane; the point nearest to all of them by squares.
        flat = n - np.einsum("gvi,gi->gv", n, self.along)[..., None] * self.along[:, None]
        beside = np.where(rays[..., None], np.cross(self.along[:, None], np.nan_to_num(views.ray["middle"])), 0.0)
        rays = rays & (np.linalg.norm(beside, axis=-1) > 1e-12)
        beside = _unit(beside)
        normal = np.where(planes[..., None], flat, np.where(rays[..., None], beside, 0.0))
        offset = np.where(planes, views.offset, (beside * np.nan_to_num(views.centre)).sum(-1))
        square = np.where(planes | rays, views.weight, 0.0) ** 2
        self.at = np.einsum("gij,gj->gi", np.linalg.pinv(np.einsum("gv,gvi,gvj->gij", square, normal, normal), rcond=1e-10, hermitian=True), np.einsum("gv,gvi,gv->gi", square, normal, offset))
        self._from_one_plane(planes, rays, np.flatnonzero(planes.sum(1) == 1))
        flip = np.take_along_axis(self.along, np.abs(self.along).argmax(1)[:, None], 1) < 0  # the largest part of a direction is positive
        self.along = np.where(flip, -self.along, self.along)
        self._extend()

    def _from_one_plane(self, planes: np.ndarray, rays: np.ndarray, groups: np.ndarray) -> None:
        """The line through where rays that are steep enough pierce the one plane of their group."""
        v = self.views
        for g in groups:
            k = int(planes[g].argmax())
            n = v.normal[g, k]
            steep = v.ray["middle"][g] @ n
            use = rays[g] & (np.abs(np.nan_to_num(steep)) >= np.sin(np.radians(self.rules.angle)))
            far = np.divide(v.offset[g, k] - v.centre[g] @ n, steep, out=np.zeros(len(steep)), where=use)
            use &= far > 0
            if use.sum() < 2:
                continue
            p, w = v.centre[g][use] + far[use][:, None] * v.ray["middle"][g][use], v.weight[g][use]
            mean = (w[:, None] * p).sum(0) / w.sum()
            along = np.linalg.eigh(np.einsum("k,ki,kj->ij", w, p - mean, p - mean))[1][:, -1]
            along = _unit(along - (along @ n) * n)
            if np.ptp((p - mean) @ along) < 1.0:
                continue
            self.known[g], self.at[g], self.along[g], self.condition[g] = True, mean, along, np.abs(steep[use]).min()

    def place(self, ray: np.ndarray) -> np.ndarray:
        """Where along the line, from at, it comes nearest to each view's ray."""
        between = np.nan_to_num(self.views.centre) - self.at[:, None]
        b = np.einsum("gvi,gi->gv", ray, self.along)
        d, e = np.einsum("gi,gvi->gv", self.along, between), np.einsum("gvi,gvi->gv", ray, between)
        steep = 1 - b * b
        return np.divide(d - b * e, steep, out=np.zeros_like(d), where=steep > 1e-12)

    def _extend(self) -> None:
        """low and high: of each view and of all kept; at becomes their middle."""
        planes = self.kept & self.views.plane
        ends = np.stack([self.place(np.nan_to_num(self.views.ray[n])) for n in ("one", "other")])
        low, high = np.where(planes, ends.min(0), np.nan), np.where(planes, ends.max(0), np.nan)
        many = planes.sum(1) > 3
        self.low, self.high = np.zeros(len(planes)), np.zeros(len(planes))
        for some, a, b in ((~many, 0, 100), (many, 10, 90)):
            some = some & planes.any(1)
            if some.any():
                self.low[some], self.high[some] = np.nanpercentile(low[some], a, axis=1), np.nanpercentile(high[some], b, axis=1)
        middle = (self.low + self.high) / 2
        self.at = self.at + middle[:, None] * self.along
        self.lows, self.highs = low - middle[:, None], high - middle[:, None]
        self.low, self.high = self.low - middle, self.high - middle

    def residuals(self) -> tuple[np.ndarray, np.ndarray]:
        """Pixels, and degrees for elongated views, between every view and the line as it draws it."""
        v = self.views
        drawn = np.einsum("gvij,gvj->gvi", np.nan_to_num(v.turn), np.cross(self.along[:, None], self.at[:, None] - np.nan_to_num(v.centre)))
        slope = drawn[..., :2] / v.lens
        size = np.linalg.norm(slope, axis=-1)

        def away(n: str) -> np.ndarray:
            return np.divide(np.abs((drawn * v.straight[n]).sum(-1)), size, out=np.full(size.shape, np.inf), where=size > 1e-12)

        pixels = np.where(v.plane, (away("one") + away("other")) / 2, away("middle"))
        axis = (v.straight["other"] - v.straight["one"])[..., :2] * v.lens
        cosine = np.abs(axis[..., 0] * slope[..., 1] - axis[..., 1] * slope[..., 0]) / (np.linalg.norm(axis, axis=-1) * np.where(size > 0, size, 1.0))
        return np.where(v.there, pixels, np.nan), np.degrees(np.arccos(np.clip(cosine, 0, 1)))

    def behind(self) -> np.ndarray:
        """Groups with the line's middle behind a kept view."""
        depth = np.einsum("gvi,gvi->gv", np.nan_to_num(self.views.turn[..., 2, :]), self.at[:, None] - np.nan_to_num(self.views.centre))
        return (self.kept & (depth <= 0)).any(1)

    def completed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """low, high and whether more than the tolerance was put on: a stretch shorter than the known length grows from the end that more views reach, by halves on a tie."""
        r = self.rules
        if r.length is None:
            return self.low, self.high, np.zeros(len(self.low), bool)
        reach_low = (self.lows <= (self.low + r.tolerance)[:, None]).sum(1)
        reach_high = (self.highs >= (self.high - r.tolerance)[:, None]).sum(1)
        missing = np.clip(r.length - (self.high - self.low), 0, None)
        share = np.where(reach_low > reach_high, 0.0, np.where(reach_high > reach_low, 1.0, 0.5))
        return self.low - share * missing, self.high + (1 - share) * missing, missing > r.tolerance


def _without(kept: np.ndarray, groups: np.ndarray, drop: np.ndarray) -> np.ndarray:
    """kept without one view of some groups."""
    out = kept.copy()
    out[np.flatnonzero(groups), drop[groups]] = False
    return out


def fitted(views: Views, rules: Rules) -> Lines:
    """Drops views until the rest agree. A view goes that spans too much by itself, whose stretch lies apart from the others', or which is furthest beyond the gate; with two views left the group has no line."""
    kept = views.plane | views.point
    failed = np.zeros(len(kept), bool)
    while True:
        lines = Lines(views, kept, rules)
        failed |= ~lines.known | lines.behind()
        n = kept.sum(1)
        spans = lines.highs - lines.lows
        long = np.zeros_like(kept) if rules.length is None else np.nan_to_num(spans) > rules.merged * rules.length
        long &= ~failed[:, None]
        gap = np.maximum(lines.lows[:, :, None], lines.lows[:, None]) - np.minimum(lines.highs[:, :, None], lines.highs[:, None])
        apart = np.where(np.isfinite(gap), gap, -np.inf)
        apart[:, np.arange(kept.shape[1]), np.arange(kept.shape[1])] = -np.inf
        planes = (kept & views.plane).sum(1)
        wide = np.zeros(len(kept), bool) if rules.length is None else lines.high - lines.low > rules.merged * rules.length
        loose = ~failed & ~long.any(1) & (planes >= 2) & ((apart.max(axis=(1, 2)) > rules.gap) | wide)
        centre = np.where(np.isfinite(lines.lows), (lines.lows + lines.highs) / 2, np.nan)
        odd = np.zeros(len(kept), int)
        if loose.any():
            own = centre[loose]
            odd[loose] = np.nanargmax(np.abs(own - np.nanmedian(own, axis=1, keepdims=True)), axis=1)
        away = np.where(kept, lines.residuals()[0], -np.inf)
        over = ~failed & ~long.any(1) & ~loose & (away.max(1) > rules.gate)
        failed |= (loose & (planes < 3)) | (over & (n < 3))
        smaller = _without(_without(kept & ~long, loose & ~failed, odd), over & ~failed, away.argmax(1))
        if (smaller == kept).all():
            lines.known &= ~failed
            return lines
        kept = smaller


def held_out(views: Views, rules: Rules) -> dict[str, np.ndarray]:
    """For every view the line of the others: whether there is one, pixels and degrees between it and the view, and its condition."""
    every = views.plane | views.point
    out = {n: np.full(every.shape, np.nan) for n in ("pixels", "degrees", "condition")}
    out["known"] = np.zeros(every.shape, bool)
    for k in range(every.shape[1]):
        rest = every.copy()
        rest[:, k] = False
        lines = Lines(views, rest, rules)
        away, degrees = lines.residuals()
        out["known"][:, k], out["pixels"][:, k], out["degrees"][:, k], out["condition"][:, k] = lines.known, away[:, k], degrees[:, k], lines.condition
    return out


def _gathered(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row a group; of several rows of one view the heaviest stays, then the first by its values, so no group outgrows the rig."""
    row = F.struct((-F.col("weight").cast("double")).alias("less"), *(F.col(c).cast("array<double>").alias(c) for c in FIELDS))
    x = df.where(F.col("view").isNotNull() & (F.col("weight") > 0)).groupBy(*keys, "view").agg(F.min(row).alias("_row"))
    return x.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("view", (-F.col("_row.less")).alias("weight"), *(F.col(f"_row.{c}").alias(c) for c in FIELDS)))).alias("_views"))


def _read(df: DataFrame, keys: list[str], schema: str, one) -> DataFrame:
    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for at in range(0, len(x), 2000):
                part = x.iloc[at : at + 2000]
                yield one(part[keys].reset_index(drop=True), Views([list(v) for v in part["_views"]]))

    typed = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    return _gathered(df, keys).mapInPandas(go, typed + schema)


def line_fits(df: DataFrame, keys: list[str], rules: Rules = Rules()) -> DataFrame:
    """keys, point (the middle of what is seen), direction (its largest part positive), low and high (ends, from point), completed, condition, worst (pixels), views (kept), dropped.

    df holds the columns of FIELDS, view and weight. A row without a view or a positive weight doesn't count; groups whose views give no line have no row.
    """

    def one(found: pd.DataFrame, views: Views) -> pd.DataFrame:
        lines = fitted(views, rules)
        low, high, completed = lines.completed()
        away = np.where(lines.kept, lines.residuals()[0], -np.inf).max(1)
        names = lambda mask: [[n for n, m in zip(v, row) if m] for v, row in zip(views.names, mask)]
        found["point"], found["direction"], found["low"], found["high"] = list(lines.at), list(lines.along), low, high
        found["completed"], found["condition"], found["worst"] = completed, lines.condition, away
        found["views"], found["dropped"] = names(lines.kept), names(views.there & ~lines.kept)
        return found[lines.known]

    kind = df.schema["view"].dataType.simpleString()
    return _read(df, keys, f"point array<double>, direction array<double>, low double, high double, completed boolean, condition double, worst double, views array<{kind}>, dropped array<{kind}>", one)


def lines_left_out(df: DataFrame, keys: list[str], rules: Rules = Rules()) -> DataFrame:
    """keys, view, fitted, pixels, degrees, condition for each elongated view, against the line of the other views of its group; all null where they give none."""

    def one(found: pd.DataFrame, views: Views) -> pd.DataFrame:
        told = held_out(views, rules)
        g, k = np.nonzero(views.plane)
        out = found.iloc[g].reset_index(drop=True)
        out["view"], out["fitted"] = [views.names[i][j] for i, j in zip(g, k)], told["known"][g, k]
        for n in ("pixels", "degrees", "condition"):
            out[n] = np.where(told["known"][g, k], told[n][g, k], np.nan)
        return out

    x = _read(df, keys, f"view {df.schema['view'].dataType.simpleString()}, fitted boolean, pixels double, degrees double, condition double", one)
    return x.withColumns({n: F.when(F.col("fitted"), F.col(n)) for n in ("pixels", "degrees", "condition")})
