"""Measures along a track or a clock: smoothing, flips, onsets, moves, dilated sets, boundaries, choices between two masks."""

from __future__ import annotations

import functools
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.operators import islands
from sightline.operators.graph import checkpoints


def fit_weights(rows: int, degree: int) -> np.ndarray:
    """Row i: the weights of the values at 0 .. rows - 1 in the polynomial fitted to them, at i."""
    a = np.vander(np.arange(rows, dtype=float) - rows // 2, degree + 1, increasing=True)
    return a @ np.linalg.pinv(a)


def local_fit(df: DataFrame, keys: list[str], order: str, value: str, rows: int = 5, degree: int = 2, name: str = "smoothed") -> DataFrame:
    """A polynomial fitted to an odd number of rows around each row; those near an end take the fit of the outermost rows.

    Keys with fewer rows than that get the middle weights with zeros beyond their ends.
    """
    half, weights = rows // 2, fit_weights(rows, degree)
    w = Window.partitionBy(*keys).orderBy(order)
    x = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))

    def at(place: int) -> Column:
        """The fit at a place among its rows."""
        out = F.lit(0.0)
        for j in range(rows):
            out = out + F.lit(float(weights[place][j])) * F.coalesce(F.lag(value, place - j).over(w), F.lit(0.0))
        return out

    fit = F.when(F.col("_n") < rows, at(half))
    for k in range(half):
        fit = fit.when(F.col("_i") == k, at(k)).when(F.col("_i") == F.col("_n") - 1 - k, at(rows - 1 - k))
    return x.withColumn(name, fit.otherwise(at(half))).drop("_i", "_n")


def flips(df: DataFrame, keys: list[str], at: str, state: str, held: str, on: dict[str, Column], off: dict[str, Column], reach: int = 15) -> DataFrame:
    """keys, at, kind, before, target, frames, first: where a state that is true, false or undecided turns, and the region it happened in.

    One row for each key and step. Turning on looks into the regions on over the reach rows before; turning off looks into the regions off within reach steps of the last row that
    is held (if that is not further back) or of the flip. A first decision that is false is no flip. The region with most rows is the target, of equal ones that met first, then the
    first named; target, frames and first are null where none was met.
    """
    order = Window.partitionBy(*keys).orderBy(at)
    now, here = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys).orderBy(F.col(at).cast("long")).rangeBetween(-reach, reach)

    def met(regions: dict[str, Column], w) -> Column:
        some = F.lit(False)
        for r in regions.values():
            some = some | F.coalesce(r, F.lit(False))
        each = [F.struct(F.count(F.when(r, 1)).over(w).alias("n"), (-F.min(F.when(r, F.col(at))).over(w)).alias("early"), F.lit(-i).alias("place"), F.lit(name).alias("target")) for i, (name, r) in enumerate(regions.items())]
        best = F.array_max(F.array(*each))
        return F.struct(F.when(best.n > 0, best.target).alias("target"), F.count(F.when(some, 1)).over(w).alias("frames"), F.min(F.when(some, F.col(at))).over(w).alias("first"))

    x = df.withColumn("_before", F.last(state, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("_on", met(on, order.rowsBetween(-reach, 0))).withColumn("_off", met(off, here))
    x = x.withColumn("_held", F.last(F.when(F.col(held), F.struct(F.col(at).alias("at"), "_off")), ignorenulls=True).over(now))
    turns = F.col(state) & ~F.coalesce(F.col("_before"), F.lit(False)) | ~F.col(state) & F.coalesce(F.col("_before"), F.lit(False))
    where = F.when(F.col(state), F.col("_on")).when(F.col(at) - F.col("_held.at") <= reach, F.col("_held._off")).otherwise(F.col("_off"))
    x = x.filter(turns).select(*keys, at, F.when(F.col(state), "on").otherwise("off").alias("kind"), F.col("_before").alias("before"), where.alias("_w"))
    return x.select(*keys, at, "kind", "before", "_w.target", F.when(F.col("_w.frames") > 0, F.col("_w.frames")).alias("frames"), F.col("_w.first").alias("first"))


def onsets(df: DataFrame, keys: list[str], at: str, bad: Column, error: str, agreeing: str, shortest: int, gap: int, least_run: int, least_agreeing: int) -> DataFrame:
    """keys, start, stop, episodes, error, worst, agreeing, reason: the runs in which bad holds, those shorter than shortest left out and the others joined over gaps.

    error and agreeing stand as they are at the onset, worst is the largest error of the run, gaps included; the reason says why an onset can't be corrected, else null.
    """
    runs = islands.runs(df.filter(bad), keys, at).filter(F.col("n") >= shortest).withColumn("stop", F.col("last") + 1)
    joined = islands.merge_intervals(runs, keys, "first", "stop", gap).filter(F.col("stop") - F.col("start") >= least_run).withColumnRenamed("n", "episodes")
    # each step finds its run by one sort: the steps and the runs of a key in one order
    steps = df.select(*keys, F.col(at).alias("_at"), F.col(error).alias("_e"), F.col(agreeing).alias("_g"), F.lit(None).cast(joined.schema["stop"].dataType).alias("_stop"), F.lit(None).cast("long").alias("_k"), F.lit(1).alias("_kind"))
    heads = joined.select(*keys, F.col("start").alias("_at"), F.lit(None).cast("double").alias("_e"), F.lit(None).cast("long").alias("_g"), F.col("stop").alias("_stop"), F.col("episodes").alias("_k"), F.lit(0).alias("_kind"))
    w = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    x = heads.unionByName(steps).withColumn("_r", F.last(F.when(F.col("_kind") == 0, F.struct(F.col("_at").alias("start"), F.col("_stop").alias("stop"), F.col("_k").alias("episodes"))), ignorenulls=True).over(w))
    x = x.filter((F.col("_kind") == 1) & (F.col("_at") < F.col("_r.stop")))
    out = x.groupBy(*keys, F.col("_r.start").alias("start"), F.col("_r.stop").alias("stop"), F.col("_r.episodes").alias("episodes")).agg(
        F.min_by("_e", "_at").alias("error"), F.max("_e").alias("worst"), F.min_by("_g", "_at").alias("agreeing")
    )
    reason = F.when(F.col("start") < 1, "the first frame is the seed").when(F.col("agreeing") < least_agreeing, F.format_string(f"%d agree, {least_agreeing} required", "agreeing"))
    return out.withColumn("reason", reason)


def moved(df: DataFrame, keys: list[str], view: str, at: str, point: Column, most: Column) -> DataFrame:
    """keys, at, views: steps at which a thing's place has moved by more than most since the step before, in two views or in all that saw it at both."""
    w = Window.partitionBy(*keys, view).orderBy(at)
    x = df.select(*keys, view, at, point.alias("_p"), most.alias("_most"))
    x = x.withColumn("_q", F.when(F.lag(at).over(w) == F.col(at) - 1, F.lag("_p").over(w))).filter(F.col("_q").isNotNull() & F.col("_p").isNotNull())
    far = F.sqrt(F.pow(F.col("_p")[0] - F.col("_q")[0], 2) + F.pow(F.col("_p")[1] - F.col("_q")[1], 2)) > F.col("_most")
    x = x.groupBy(*keys, at).agg(F.count("*").alias("_n"), F.array_sort(F.collect_set(F.when(far, F.col(view)))).alias("views"))
    return x.filter((F.size("views") > 0) & (F.size("views") >= F.least(F.lit(2), F.col("_n")))).drop("_n")


def dilated(df: DataFrame, keys: list[str], at: str, radius: int, start: int, stop: int) -> DataFrame:
    """keys, at: every step in start .. stop - 1 at most radius from one of the key's steps, each once. Intervals are joined before they are written out."""
    x = df.select(*keys, F.greatest(F.col(at) - radius, F.lit(start)).alias("_a"), F.least(F.col(at) + radius + 1, F.lit(stop)).alias("_b")).filter("_a < _b").distinct()
    x = islands.merge_intervals(x, keys, "_a", "_b")
    return x.select(*keys, F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias(at))


def padded(df: DataFrame, keys: list[str], start: str, stop: str, by: int, first: int, last: int) -> DataFrame:
    """keys, start, stop: intervals wider by some steps at both ends, inside first .. last - 1, joined where they touch."""
    x = df.select(*keys, F.greatest(F.col(start) - by, F.lit(first)).alias("start"), F.least(F.col(stop) + by, F.lit(last)).alias("stop")).filter("start < stop")
    return islands.merge_intervals(x, keys, "start", "stop")


def boundaries(df: DataFrame, keys: list[str], at: str, label: str) -> DataFrame:
    """keys, at, before, label: where the label differs from the row before; missing labels are a label."""
    w = Window.partitionBy(*keys).orderBy(at)
    x = df.select(*keys, at, label, F.lag(label).over(w).alias("before"), F.row_number().over(w).alias("_i"))
    return x.filter((F.col("_i") > 1) & ~F.col("before").eqNullSafe(F.col(label))).drop("_i")


def method_agreement(df: DataFrame, key: list[str], method: str, present: str, value: str, within: float) -> DataFrame:
    """a, b, answered, presence, found, near, gap: each two methods over the rows both answer: how often they agree on presence, and how close their values lie where both see it.

    One row for each key and method; methods are few by definition.
    """
    x = df.filter(F.col(present).isNotNull())
    a = x.select(*key, F.col(method).alias("a"), F.col(present).alias("_pa"), F.col(value).alias("_va"))
    b = x.select(*key, F.col(method).alias("b"), F.col(present).alias("_pb"), F.col(value).alias("_vb"))
    both = F.col("_pa") & F.col("_pb")
    gap = F.when(both, F.abs(F.col("_va") - F.col("_vb")))
    return a.join(b, key).filter("a < b").groupBy("a", "b").agg(
        F.count("*").alias("answered"), F.avg((F.col("_pa") == F.col("_pb")).cast("double")).alias("presence"), F.count(F.when(both, 1)).alias("found"),
        F.avg((gap <= within).cast("double")).alias("near"), F.percentile(gap, F.lit(0.5)).alias("gap"),
    )


def mean_histogram(df: DataFrame, keys: list[str], counts: str) -> DataFrame:
    """keys, bin, share: the mean of the rows' normalised histograms; rows without counts are left out."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    x = df.select(*keys, counts, total.alias("_t")).filter("_t > 0").select(*keys, "_t", F.posexplode(counts).alias("bin", "_c"))
    return x.groupBy(*keys, "bin").agg(F.avg(F.col("_c") / F.col("_t")).alias("share"))


def one_per_step(df: DataFrame, keys: list[str], at: str, thing: str, single: list[str], *order: Column) -> DataFrame:
    """The rows with object: things of a class in single (the last of keys) are one object, of whose rows at one step the first by order stays; other things are their own."""
    lone = F.col(keys[-1]).isin(single)
    w = Window.partitionBy(*keys, at, F.when(~lone, F.col(thing))).orderBy(*order)
    x = df.withColumn("_k", F.when(lone, F.row_number().over(w)).otherwise(1)).filter("_k = 1").drop("_k")
    return x.withColumn("object", F.when(lone, F.lit(None)).otherwise(F.col(thing)))


def nested(df: DataFrame, keys: list[str], thing: str, at: str, holds: Column, shared: int = 5, share: float = 0.5, often: float = 0.5, block: int = 256) -> DataFrame:
    """keys, thing, kept, steps, nested: things that repeat another one of their key on most of the steps they share.

    holds is the condition over the two boxes (structs _a and _b, each a whole row, the smaller name first). Two things count if they share at least shared steps and share of the shorter one's.
    The thing with more steps is kept, the smaller name first among equals. What is gone takes nothing with it, so in that order only kept things are ever compared with later ones: a round
    settles the next block of a key's things among themselves and compares those it keeps with all that are left, of which those that repeat one go. Where much repeats, few are kept and
    rounds are few; where nothing repeats, every pair is met once, block by block. Pairs are counted where they are made and never shuffled; one task sees a block's surviving pairs alone.
    """
    checkpoints(df.sparkSession)
    name = [*keys, "_t"]
    boxes = df.filter(F.col(thing).isNotNull()).dropna(subset=keys).select(*keys, F.col(thing).alias("_t"), F.col(at).alias("_at"), F.struct(*df.columns).alias("_row")).checkpoint()
    left = boxes.groupBy(*name).agg(F.count("*").alias("_n")).checkpoint()
    types = {f.name: f.dataType.simpleString() for f in left.schema}
    pair = [*keys, "_t", "_kept", "_n", "_m", "steps", "nested"]
    schema = ", ".join([*(f"{k} {types[k]}" for k in name), f"_kept {types['_t']}, steps long, nested double"])

    def pairs(later: DataFrame, earlier: DataFrame, parts: DataFrame | None) -> DataFrame:
        """Things with those of earlier that they repeat. Keys with many things are dealt over parts, of which each has all of the key's earlier things."""
        if parts is None:
            later, earlier = later.withColumn("_part", F.lit(0)), earlier.withColumn("_part", F.lit(0))
        else:
            many = F.coalesce("_parts", F.lit(1))
            later = later.join(parts, keys, "left").withColumn("_part", F.pmod(F.hash("_t"), many).cast("int"))
            earlier = earlier.join(parts, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), many - 1)))
        a = boxes.join(later, name).select(*name, "_part", "_at", F.col("_n").alias("_m"), F.col("_row").alias("_x")).repartition(*keys, "_part")
        b = boxes.join(earlier, name).select(*keys, "_part", "_at", F.col("_t").alias("_kept"), "_n", F.col("_row").alias("_y")).repartition(*keys, "_part")
        x = a.join(b.hint("merge"), [*keys, "_part", "_at"]).filter((F.col("_n") > F.col("_m")) | (F.col("_n") == F.col("_m")) & (F.col("_kept") < F.col("_t")))
        swap = F.col("_kept") < F.col("_t")
        x = x.withColumn("_a", F.when(swap, F.col("_y")).otherwise(F.col("_x"))).withColumn("_b", F.when(swap, F.col("_x")).otherwise(F.col("_y")))
        x = x.groupBy(*keys, "_part", "_t", "_kept", "_n", "_m").agg(F.count("*").alias("steps"), F.avg(holds.cast("double")).alias("nested"))
        return x.filter((F.col("steps") >= F.greatest(F.lit(float(shared)), share * F.col("_m"))) & (F.col("nested") >= often))

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_n", "_kept", "_m", "_t"], ascending=[False, True, False, True])
        gone: set = set()
        taken = []
        for i, k, t in zip(rows.index, rows["_kept"], rows["_t"]):
            if k not in gone and t not in gone:
                gone.add(t)
                taken.append(i)
        return rows.loc[taken, [*name, "_kept", "steps", "nested"]]

    done: list[DataFrame] = []
    while True:
        turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_n"), "_t"))
        first = left.withColumn("_k", turn).filter(F.col("_k") <= block).drop("_k").checkpoint()
        lost = pairs(first, first, None).select(*pair).groupBy(*keys).applyInPandas(keep, schema).checkpoint()
        done.append(lost)
        left = left.join(first, name, "left_anti").checkpoint()
        if left.isEmpty():
            break
        parts = left.groupBy(*keys).count().filter(F.col("count") > 4 * block).select(*keys, F.ceil(F.col("count") / (4 * block)).cast("int").alias("_parts"))
        found = pairs(left, first.join(lost, name, "left_anti"), F.broadcast(parts))  # of keys with many things, so few of them
        least = F.min(F.struct((-F.col("_n")).alias("order"), "_kept", "steps", "nested")).alias("_p")
        lost = found.groupBy(*keys, "_part", "_t").agg(least).select(*name, "_p._kept", "_p.steps", "_p.nested").checkpoint()
        done.append(lost)
        left = left.join(lost, name, "left_anti").checkpoint()
        if left.isEmpty():
            break
        block = min(2 * block, max(block, 1024))
        if len(done) > 32:
            done = [functools.reduce(DataFrame.unionByName, done).checkpoint()]
    out = functools.reduce(DataFrame.unionByName, done)
    return out.select(*keys, F.col("_t").alias(thing), F.col("_kept").alias("kept"), "steps", "nested")


def nearest_in_order(df: DataFrame, keys: list[str], side: str, item: str, point: str) -> DataFrame:
    """keys, left, right: each left item in its order takes the nearest right one that is left; both sides' leftovers stay, with null for the other.

    side is true for left; items are longs and a key's items meet in one task, as they are one frame's detections.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "left long, right long"])

    def pair(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(item)
        a, b = rows[rows[side]], rows[~rows[side]]
        spots, free = np.array(b[point].tolist(), float), np.ones(len(b), bool)
        out = []
        for name, p in zip(a[item], a[point]):
            if not free.any():
                out.append((name, None))
                continue
            far = np.where(free, np.sqrt(((spots - np.asarray(p, float)) ** 2).sum(axis=1)), np.inf)
            free[best := int(far.argmin())] = False
            out.append((name, b[item].iloc[best]))
        out += [(None, name) for name in b[item][free]]
        made = pd.DataFrame(out, columns=["left", "right"]).astype("Int64")
        for k in reversed(keys):
            made.insert(0, k, rows[k].iloc[0])
        return made

    return df.select(*keys, side, item, point).groupBy(*keys).applyInPandas(pair, schema)


def ensemble(
    rows: pd.DataFrame, width: int, window: int = 90, samples: int = 5, small: float = 0.5, other: float = 0.6, bounds: tuple[float, float] = (0.5, 1.6), iou: float = 0.3, step: float = 20.0, growth: float = 2.0
) -> pd.DataFrame:
    """choice and fired for each row (frame, primary, fallback, others, hidden, inside) of one target in frame order.

    The primary mask stands unless the frame lies inside a policy interval and a rule speaks against it: it is missing, much smaller than the running median of accepted areas, on another
    target's mask, or apart from the last accepted mask. Then the fallback is taken if it is of a sane size and continuous; else the primary stays as 'unsane'. Only what is accepted enters
    the median and the continuity. Masks are sets of pixel numbers in rows of width.
    """
    areas: deque = deque()
    last: tuple[int, set, np.ndarray] | None = None

    def middle(mask: set) -> np.ndarray:
        p = np.fromiter(mask, np.int64)
        return np.array([(p % width).mean(), (p // width).mean()])

    def continuous(frame: int, mask: set) -> bool:
        if last is None:
            return True
        at, before, place = last
        if len(mask & before) / len(mask | before) >= iou:
            return True
        return bool(np.hypot(*(middle(mask) - place)) <= step + growth * (frame - at))

    choices, rules = [], []
    for frame, primary, fallback, others, hidden, inside in zip(*(rows[c] for c in ("frame", "primary", "fallback", "others", "hidden", "inside"))):
        first, second = (set(m) if m is not None else set() for m in (primary, fallback))
        recent = [n for f, n in areas if frame - window <= f < frame]
        recent = recent if len(recent) >= samples else [n for _, n in areas]
        usual = float(np.median(recent)) if recent else None
        fired = []
        if not first:
            fired.append("missing")
        else:
            if usual is not None and len(first) < small * usual:
                fired.append("small")
            if any(len(first & set(o)) / len(first | set(o)) > other for o in (others if others is not None else ()) if o is not None and len(o)):
                fired.append("other")
            if not continuous(frame, first):
                fired.append("apart")
        taken: set | None = None
        if hidden:
            choice, fired = "hidden", []
        elif not inside or not fired:
            choice, taken = ("primary", first) if first else ("missing", None)
        elif second and (usual is None or bounds[0] * usual <= len(second) <= bounds[1] * usual) and continuous(frame, second):
            choice, taken = "fallback", second
        else:
            choice = "unsane" if first else "missing"
        if taken:
            last = (frame, taken, middle(taken))
            areas.append((frame, len(taken)))
            while areas[0][0] < frame - 2 * window:
                areas.popleft()
        choices.append(choice)
        rules.append(",".join(fired))
    return rows.assign(choice=choices, fired=rules)


def ensemble_choices(df: DataFrame, keys: list[str], width: int, **options) -> DataFrame:
    """keys, frame, choice, fired. A target's frames meet in one task, as each choice rests on those before it."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "frame long, choice string, fired string"])

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        return ensemble(rows.sort_values("frame"), width, **options)[[*keys, "frame", "choice", "fired"]]

    return df.select(*keys, "frame", "primary", "fallback", "others", "hidden", "inside").groupBy(*keys).applyInPandas(one, schema)
