"""Fits over points and pixels: sums and covariances by group in Spark, and one small matrix for each group, or row, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.expressions import distance, dot


def _typed(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def similarity(df: DataFrame, keys: list[str], source: str, target: str, scaled: bool = True) -> DataFrame:
    """keys, scale, turn (nine values, row by row), shift: target is nearest to scale * turn * source + shift, by least squares and without a mirror.

    Rows that lack a point don't count; fewer than three leave out their group. A source without extent has a null scale and shift.
    """
    at = lambda c, i: F.col(c)[i].cast("double")
    three = range(3)
    sums = df.where(F.col(source).isNotNull() & F.col(target).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.array(*(F.covar_pop(at(target, i), at(source, j)) for i in three for j in three)).alias("_cov"),
        sum((F.var_pop(at(source, i)) for i in three), F.lit(0.0)).alias("_var"),
        *(F.array(*(F.avg(at(c, i)) for i in three)).alias(n) for c, n in ((source, "_s"), (target, "_t"))),
    )

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if not len(x):
                continue
            u, spread, v = np.linalg.svd(np.stack(x["_cov"].to_list()).reshape(-1, 3, 3))
            sign = np.ones((len(x), 3))
            sign[:, 2] = np.where(np.linalg.det(u @ v) < 0, -1.0, 1.0)
            turn = (u * sign[:, None]) @ v
            var = x["_var"].to_numpy(float)
            scale = np.divide((spread * sign).sum(axis=1), var, out=np.full(len(x), np.nan), where=var > 0) if scaled else np.ones(len(x))
            shift = np.stack(x["_t"].to_list()) - scale[:, None] * np.einsum("nij,nj->ni", turn, np.stack(x["_s"].to_list()))
            out = x[keys].copy()
            out["scale"] = scale
            out["turn"], out["shift"] = list(turn.reshape(-1, 9)), list(shift)
            yield out

    found = sums.where(F.col("_n") >= 3).mapInPandas(fit, _typed(df, keys) + "scale double, turn array<double>, shift array<double>")
    known = F.col("scale").isNotNull() & ~F.isnan("scale")
    return found.select(*keys, F.when(known, F.col("scale")).alias("scale"), "turn", F.when(known, F.col("shift")).alias("shift"))


def lowest_plane(df: DataFrame, keys: list[str], point: str, down: Column, share: float = 0.05, below: float = 20.0) -> DataFrame:
    """keys, normal (against down), offset, centre, points, fitted, degrees, rms, p95, below: the plane through the lowest share of a group's points.

    below is the share of all points that lie more than below under the plane. Rows without a point don't count; fewer than three fitted points leave out their group.
    """
    p = lambda i: F.col("_p")[i].cast("double")
    x = df.where(F.col(point).isNotNull()).select(*keys, F.col(point).alias("_p"), down.alias("_down")).withColumn("_height", dot(F.col("_p"), F.col("_down")))
    cut = x.groupBy(*keys).agg(F.percentile("_height", F.lit(1 - share)).alias("_cut"), F.count("*").alias("points"))
    low = x.join(cut, keys).where(F.col("_height") >= F.col("_cut"))
    sums = low.groupBy(*keys).agg(
        F.count("*").alias("fitted"),
        F.first("points").alias("points"),
        F.first("_down").alias("_down"),
        F.first("_cut").alias("_cut"),
        F.array(*(F.covar_pop(p(i), p(j)) for i in range(3) for j in range(3))).alias("_cov"),
        F.array(*(F.avg(p(i)) for i in range(3))).alias("centre"),
    )

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            normal = np.linalg.eigh(np.stack(b["_cov"].to_list()).reshape(-1, 3, 3))[1][:, :, 0]
            against = (normal * np.stack(b["_down"].to_list())).sum(axis=1) > 0
            out = b[[*keys, "fitted", "points", "_cut", "_down", "centre"]].copy()
            out["normal"] = list(np.where(against[:, None], -normal, normal))
            yield out

    schema = _typed(df, keys) + "fitted long, points long, _cut double, _down array<double>, centre array<double>, normal array<double>"
    planes = sums.where(F.col("fitted") >= 3).mapInPandas(fit, schema).withColumn("offset", dot(F.col("normal"), F.col("centre")))
    off = dot(F.col("_p"), F.col("normal")) - F.col("offset")
    near = F.when(F.col("_height") >= F.col("_cut"), off)
    told = x.drop("_down").join(planes, keys).groupBy(*keys).agg(
        *(F.first(c).alias(c) for c in ("normal", "offset", "centre", "points", "fitted", "_down")),
        F.sqrt(F.avg(near * near)).alias("rms"),
        F.percentile(F.abs(near), F.lit(0.95)).alias("p95"),
        F.avg((off < -below).cast("double")).alias("below"),
    )
    steep = F.greatest(F.least(-dot(F.col("normal"), F.col("_down")), F.lit(1.0)), F.lit(-1.0))
    return told.select(*keys, "normal", "offset", "centre", "points", "fitted", F.degrees(F.acos(steep)).alias("degrees"), "rms", "p95", "below")


_CELLS = [(i, j) for i in range(4) for j in range(i, 4)]


def left_out(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with away: how many pixels a view's pixel lies from the point that the other views of its keys triangulate; null with fewer than two others.

    Rows hold camera (array of 12, row by row), u and v. Views add their equations' products, so leaving one out is a difference of sums, not a fit for each view.
    """
    row = lambda of, k: [F.col(of) * F.col("camera")[8 + i] - F.col("camera")[4 * k + i] for i in range(4)]
    a, b = row("u", 0), row("v", 1)
    whole = Window.partitionBy(*keys)
    x = df.withColumn("_own", F.array(*(a[i] * a[j] + b[i] * b[j] for i, j in _CELLS)))
    others = F.array(*(F.sum(F.col("_own")[k]).over(whole) - F.col("_own")[k] for k in range(len(_CELLS))))
    x = x.withColumn("_rest", F.when(F.count("_own").over(whole) >= 3, others))

    @F.pandas_udf("array<double>")
    def nearest(products: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(products), index=products.index, dtype=object)
        there = products[products.notna()]
        if len(there):
            flat, m = np.stack(there.to_list()), np.empty((len(there), 4, 4))
            for k, (i, j) in enumerate(_CELLS):
                m[:, i, j] = m[:, j, i] = flat[:, k]
            out[there.index] = pd.Series(list(np.linalg.eigh(m)[1][:, :, 0]), index=there.index)
        return out

    x = x.withColumn("_at", nearest("_rest"))
    seen = [dot(F.slice("camera", 4 * k + 1, 4), F.col("_at")) for k in range(3)]
    away = distance(F.array(F.try_divide(seen[0], seen[2]), F.try_divide(seen[1], seen[2])), F.array(F.col("u").cast("double"), F.col("v").cast("double")))
    return x.withColumn("away", away).drop("_own", "_rest", "_at")


def axes(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, cx, cy, dx, dy, elongation, width, first, last: the main axis of each cloud of x, y, from its moments, and where its pixels begin and end along it.

    A cloud without extent has no direction; one on a line has no elongation.
    """
    m = pixels.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_pop("x").alias("_a"), F.var_pop("y").alias("_b"), F.covar_pop("x", "y").alias("_c"))
    half, root = (F.col("_a") + F.col("_b")) / 2, F.sqrt(F.pow((F.col("_a") - F.col("_b")) / 2, 2) + F.pow("_c", 2))
    angle = F.when(half > 0, F.atan2(2 * F.col("_c"), F.col("_a") - F.col("_b")) / 2)
    small = F.greatest(half - root, F.lit(0.0))
    m = m.select(*keys, "n", "cx", "cy", F.cos(angle).alias("dx"), F.sin(angle).alias("dy"), F.sqrt(F.try_divide(half + root, small)).alias("elongation"), F.sqrt(12 * small).alias("width"))
    along = (F.col("x") - F.col("cx")) * F.col("dx") + (F.col("y") - F.col("cy")) * F.col("dy")
    reach = pixels.join(m.select(*keys, "cx", "cy", "dx", "dy"), keys).groupBy(*keys).agg(F.min(along).alias("first"), F.max(along).alias("last"))
    return m.join(reach, keys)


def width_profiles(pixels: DataFrame, keys: list[str], axis: DataFrame, step: float, least: int = 2) -> DataFrame:
    """keys, bin, width: the extent across the axis (one pixel more than the difference) in bins along it with at least so many pixels; axes gives the axis."""
    x = pixels.join(axis.where(F.col("last") - F.col("first") >= step).select(*keys, "cx", "cy", "dx", "dy", "first", "last"), keys)
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    bins = F.greatest(F.ceil((F.col("last") - F.col("first")) / step), F.lit(1))
    at = F.least(F.floor((dx * F.col("dx") + dy * F.col("dy") - F.col("first")) / step), bins - 1)
    x = x.select(*keys, at.cast("long").alias("bin"), (dy * F.col("dx") - dx * F.col("dy")).alias("_across"))
    w = x.groupBy(*keys, "bin").agg(F.count("*").alias("_n"), (F.max("_across") - F.min("_across") + 1).alias("width"))
    return w.where(F.col("_n") >= least).drop("_n")


def tails(profiles: DataFrame, keys: list[str], step: float, share: float, margin: float, ratio: float) -> DataFrame:
    """keys, body, tail0, tail1, tip: thin runs from both ends of a profile, and the end whose run is longer by margin bodies and ratio times.

    body is the 75th percentile of the widths; a run lasts until two bins in a row (or the last one) reach share of it.
    """
    w = profiles.groupBy(*keys).agg(F.percentile("width", F.lit(0.75)).alias("body"), F.transform(F.array_sort(F.collect_list(F.struct("bin", "width"))), lambda s: s["width"]).alias("_w"))

    def run(widths: Column) -> Column:
        thick = F.transform(widths, lambda x: x >= share * F.col("body"))
        ends = F.filter(F.sequence(F.lit(0), F.size(widths) - 1), lambda i: F.get(thick, i) & F.coalesce(F.get(thick, i + 1), F.lit(True)))
        return F.coalesce(F.get(ends, F.lit(0)), F.size(widths)) * step

    w = w.select(*keys, "body", run(F.col("_w")).alias("tail0"), run(F.reverse("_w")).alias("tail1"))
    longer, shorter = F.greatest("tail0", "tail1"), F.least("tail0", "tail1")
    sure = (longer > 0) & (longer - shorter > margin * F.col("body")) & (longer >= ratio * shorter)
    return w.withColumn("tip", F.when(sure, F.when(F.col("tail0") > F.col("tail1"), 0).otherwise(1)))


def exclusive(pixels: DataFrame, keys: list[str], loser: float) -> DataFrame:
    """pixels (keys, pixel, slot, present, logit) with contested and resolved: of several present slots above 0 at one pixel the largest logit (the first slot of equals)
    stays, the others come down to at most loser."""
    at = Window.partitionBy(*keys, "pixel")
    claims = F.col("present") & (F.col("logit") > 0)
    rank = F.min(F.when(claims, F.struct((-F.col("logit")).alias("l"), F.col("slot").alias("s")))).over(at)
    contested = claims & (F.count_if(claims).over(at) > 1)
    beaten = contested & (F.col("slot") != rank["s"])
    return pixels.withColumn("contested", contested).withColumn("resolved", F.when(beaten, F.least("logit", F.lit(loser))).otherwise(F.col("logit")))


def pooled_vector(df: DataFrame, keys: list[str], vector: str, weight: Column, size: int) -> DataFrame:
    """keys, pooled: the weighted mean of vectors of one size, of length 1; null without weight or length."""
    x = df.withColumn("_w", weight)
    sums = x.groupBy(*keys).agg(F.sum("_w").alias("_w"), F.array(*(F.sum(F.col("_w") * F.col(vector)[i]) for i in range(size))).alias("_v"))
    length = F.sqrt(dot(F.col("_v"), F.col("_v")))
    return sums.select(*keys, F.when((F.col("_w") > 1e-6) & (length > 0), F.transform("_v", lambda v: v / length)).alias("pooled"))


def agreed_offset(curves: DataFrame, keys: list[str], most: float, doubtful: int) -> DataFrame:
    """keys, chosen, offset, uncertainty, dropped: metrics vote with the median of their peaks (metric, peak; a null peak is no vote).

    offset is the mean of the medians, chosen its nearest whole number. Medians more than most apart give no offset, but of exactly three metrics two within most outvote
    the third, if just one of the two gaps is so small; the uncertainty is then at least doubtful, else 1.
    """
    one = curves.where(F.col("peak").isNotNull()).groupBy(*keys, "metric").agg(F.median("peak").alias("m"))
    x = one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("m", "metric"))).alias("_m"))
    m = lambda i: F.get("_m", F.lit(i))["m"]
    low, high = m(1) - m(0) <= most, m(2) - m(1) <= most
    together = F.element_at("_m", -1)["m"] - m(0) <= most
    out = F.when(~together & (F.size("_m") == 3), F.when(low & ~high, 2).when(high & ~low, 0))
    x = x.withColumn("_out", out).withColumn("_vote", F.when(together, F.col("_m")).when(F.col("_out").isNotNull(), F.filter("_m", lambda _, i: i != F.col("_out"))))
    offset = F.aggregate("_vote", F.lit(0.0), lambda s, v: s + v["m"]) / F.size("_vote")
    x = x.withColumn("offset", F.when(F.col("_vote").isNotNull(), offset)).withColumn("chosen", F.bround("offset").cast("long"))
    apart = F.array_max(F.transform("_vote", lambda v: F.abs(v["m"] - F.col("chosen"))))
    least = F.when(F.col("_out").isNotNull(), doubtful).otherwise(1)
    return x.select(*keys, "chosen", "offset", F.greatest(least, F.ceil(apart - 1e-9)).alias("uncertainty"), F.get("_m", F.col("_out"))["metric"].alias("dropped")).withColumn("uncertainty", F.when(F.col("chosen").isNotNull(), F.col("uncertainty")))


def floors_left_out(cells: DataFrame, floors: list[float], harm_below: float, most_harm: float, least_share: float) -> DataFrame:
    """fold, floor, cells, accepted, harm, quality: for each fold the floor that did best on all others, and what it accepts in the fold.

    cells hold fold, score and quality of the best candidate (null without one); a floor accepts scores from it on. Best is the highest mean quality with a harm
    rate (quality under harm_below) up to most_harm and an acceptance from least_share, the lowest floor of equals, and the lowest of all where none will do. The others' figures are the totals less the fold's own.
    """
    x = cells.withColumn("floor", F.explode(F.array(*(F.lit(float(f)) for f in floors))))
    taken = F.col("score") >= F.col("floor")
    parts = x.groupBy("fold", "floor").agg(F.count("*").alias("cells"), F.count_if(taken).alias("accepted"), F.count_if(taken & (F.col("quality") < harm_below)).alias("harm"), F.sum(F.when(taken, F.col("quality"))).alias("quality"))
    parts = parts.fillna(0.0, ["quality"])
    totals = parts.groupBy("floor").agg(*(F.sum(c).alias("_" + c) for c in ("cells", "accepted", "harm", "quality")))
    x = parts.join(totals, "floor")
    rest = lambda c: F.col("_" + c) - F.col(c)
    fit = (rest("accepted") > 0) & (rest("accepted") >= least_share * rest("cells")) & (rest("harm") <= most_harm * rest("accepted"))
    row = F.struct(*(F.col(c) for c in ("floor", "cells", "accepted", "harm", "quality")))
    mean = F.try_divide(rest("quality"), rest("accepted"))
    best = x.groupBy("fold").agg(F.coalesce(F.max_by(row, F.when(fit, F.struct(mean, -F.col("floor")))), F.min_by(row, "floor")).alias("b"), F.max(rest("cells")).alias("_others"))
    return best.where(F.col("_others") > 0).select("fold", "b.*").withColumn("quality", F.when(F.col("accepted") > 0, F.col("quality") / F.col("accepted")))
