"""One-to-one matching, tracklets and identity scores. Functions over one group's rows, for applyInPandas by view, frame or trial."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.operators.graph import checkpoints


def greedy(cost: np.ndarray, most: float = np.inf) -> list[tuple[int, int]]:
    """Pairs by rising cost, each row and column once; ties by row, then column."""
    rows, cols = np.nonzero(cost <= most)
    order = np.lexsort((cols, rows, cost[rows, cols]))
    used_r, used_c, out = set(), set(), []
    for k in order:
        r, c = int(rows[k]), int(cols[k])
        if r not in used_r and c not in used_c:
            used_r.add(r)
            used_c.add(c)
            out.append((r, c))
    return out


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """The one-to-one assignment of least total cost. Every row of the shorter side is matched; costs must be finite.

    Rows first take their cheapest column where it is free. Each row that is left looks for the column at the end of its
    cheapest chain of exchanges, measured by what a pair costs above the prices of its row and column, and the
    prices then rise by what the chain has used up.
    """
    if cost.size == 0:
        return []
    wide = cost if cost.shape[0] <= cost.shape[1] else cost.T
    rows, columns = wide.shape
    row_price, column_price = wide.min(axis=1), np.zeros(columns)
    holder, choice = np.full(columns, -1), np.full(rows, -1)
    for row, column in enumerate(wide.argmin(axis=1)):
        if holder[column] < 0:
            holder[column], choice[row] = row, column
    for start in np.flatnonzero(choice < 0):
        excess = wide[start] - row_price[start] - column_price
        came_from = np.full(columns, start)
        closed = np.zeros(columns, bool)
        while True:
            end = int(np.where(closed, np.inf, excess).argmin())
            if holder[end] < 0:
                break
            closed[end] = True
            other = holder[end]
            onward = excess[end] + wide[other] - row_price[other] - column_price
            better = ~closed & (onward < excess)
            excess[better], came_from[better] = onward[better], other
        saved = excess[end] - excess[closed]
        row_price[start] += excess[end]
        row_price[holder[closed]] += saved
        column_price[closed] -= saved
        row = -1
        while row != start:
            row = int(came_from[end])
            holder[end], choice[row], end = row, end, int(choice[row])
    pairs = [(row, int(column)) for row, column in enumerate(choice)]
    return pairs if wide is cost else sorted((column, row) for row, column in pairs)


def match_groups(df: DataFrame, keys: list[str], side: str, item: str, value: str, most: float, optimal: bool = False) -> DataFrame:
    """keys, left, right, cost: items of side a matched with items of side b of the same group by |value difference| up to most.

    A group is cut wherever two neighbouring values are further apart than most, as no pair reaches across. Pieces are dealt over all tasks, however
    many a group has, and go through a task one after another; it holds one Arrow batch and a piece.
    """
    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), "left long, right long, cost double"])

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        edge = _edges(rows, [*keys, "_piece"])
        is_a = (rows[side] == "a").to_numpy()
        items, values = rows[item].to_numpy(), rows[value].to_numpy(float)
        ones = np.add.reduceat(is_a, edge[:-1]) if len(rows) else np.zeros(0, int)
        left, right, costs = [], [], []
        for k in np.flatnonzero((ones > 0) & (ones < np.diff(edge))):
            start, middle, stop = edge[k], edge[k] + ones[k], edge[k + 1]  # side a comes first
            cost = np.abs(values[start:middle, None] - values[None, middle:stop])
            chosen = [p for p in assignment(np.where(cost <= most, cost, 1e9)) if cost[p] <= most] if optimal else greedy(cost, most)
            left += [start + r for r, _ in chosen]
            right += [middle + c for _, c in chosen]
            costs += [cost[p] for p in chosen]
        out = rows[keys].iloc[left].reset_index(drop=True)
        return out.assign(left=items[left] if left else [], right=items[right] if right else [], cost=costs)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = _edges(rows, [*keys, "_piece"])[-2] if len(rows) else 0  # its piece may go on in the next batch
            rest = rows.iloc[last:]
            yield pairs(rows.iloc[:last])
        if rest is not None:
            yield pairs(rest)

    w = Window.partitionBy(*keys).orderBy(value)
    x = df.filter(F.col(value).isNotNull() & F.col(side).isin("a", "b")).select(*keys, side, item, value, F.coalesce((F.col(value) - F.lag(value).over(w) > most).cast("int"), F.lit(0)).alias("_cut"))
    x = x.withColumn("_piece", F.sum("_cut").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_cut")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return x.repartition(parts, *keys, "_piece").sortWithinPartitions(*keys, "_piece", side, item).mapInPandas(go, schema)


def _edges(rows: pd.DataFrame, columns: list[str]) -> np.ndarray:
    """Where each run of equal values begins, with the end. Nulls are equal."""
    if not len(rows):
        return np.zeros(1, int)
    change = np.zeros(len(rows), bool)
    for c in columns:
        codes = pd.factorize(rows[c], use_na_sentinel=True)[0]
        change[1:] |= codes[1:] != codes[:-1]
    change[0] = True
    return np.append(np.flatnonzero(change), len(rows))


def idf1(overlap: np.ndarray) -> dict:
    """Identity scores from the contingency of true and found identities: the assignment that shares the most rows."""
    pairs = assignment(-overlap.astype(float))
    tp = int(sum(overlap[p] for p in pairs))
    total_true, total_found = int(overlap.sum(axis=1).sum()), int(overlap.sum(axis=0).sum())
    return {"idtp": tp, "idfn": total_true - tp, "idfp": total_found - tp, "idf1": 2 * tp / (total_true + total_found) if total_true + total_found else None}


def identity_scores(df: DataFrame, keys: list[str], truth: str, found: str) -> DataFrame:
    """keys, idtp, idfn, idfp, idf1 over rows that hold both identities. The contingency is counted before it meets in one task."""
    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), "idtp long, idfn long, idfp long, idf1 double"])

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        table = rows.pivot_table(index=truth, columns=found, values="count", aggfunc="sum", fill_value=0)
        return pd.DataFrame([{**{k: rows[k].iloc[0] for k in keys}, **idf1(table.to_numpy())}])

    return df.filter(df[truth].isNotNull() & df[found].isNotNull()).groupBy(*keys, truth, found).count().groupBy(*keys).applyInPandas(one, schema)


def iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    wide = np.clip(np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0]), 0, None)
    high = np.clip(np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1]), 0, None)
    area = lambda x: np.clip(x[:, 2] - x[:, 0], 0, None) * np.clip(x[:, 3] - x[:, 1], 0, None)
    union = area(a)[:, None] + area(b)[None, :] - wide * high
    return np.divide(wide * high, union, out=np.zeros_like(union), where=union > 0)


CELLS = 1 << 19  # pairs of boxes that are looked at together
STRIPS = 1024


def greedy_boxes(a: np.ndarray, b: np.ndarray, least: float) -> list[tuple[int, int]]:
    """greedy(1 - iou(a, b), 1 - least) without all pairs at once: the cheapest of them are settled before the next ones are looked for among what is left."""
    if len(a) * len(b) <= 4096:
        return greedy(1 - iou(a, b), 1 - least)
    rows, cols = np.arange(len(a)), np.arange(len(b))
    free_r, free_c, out = np.ones(len(a), bool), np.ones(len(b), bool), []

    def chunks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, CELLS // len(cols))
        for k in range(0, len(rows), step):
            yield rows[k : k + step], 1 - iou(a[rows[k : k + step]], b[cols])

    def take(pairs: Iterator[tuple[int, int]]) -> None:
        for r, c in pairs:
            if free_r[r] and free_c[c]:
                free_r[r] = free_c[c] = False
                out.append((r, c))

    while len(rows) and len(cols):
        enough, bound = 16 * (len(rows) + len(cols)), None  # below bound, once there is one, every pair is held
        held = [np.zeros(0, int), np.zeros(0, int), np.zeros(0)]
        for some, cost in chunks():
            r, c = np.nonzero(cost <= 1 - least if bound is None else cost < bound)
            held = [np.concatenate(x) for x in zip(held, (some[r], cols[c], cost[r, c]))]
            if len(held[2]) > 2 * enough:
                bound = np.partition(held[2], enough)[enough]
                held = [x[held[2] < bound] for x in held]
        order = np.lexsort((held[1], held[0], held[2]))
        take(zip(held[0][order].tolist(), held[1][order].tolist()))
        if bound is None:
            break
        rows, cols = rows[free_r[rows]], cols[free_c[cols]]
        if len(rows) and len(cols):
            for some, cost in chunks():  # pairs that cost just the bound, however many, by row and column
                r, c = np.nonzero((cost == bound) & free_c[cols])
                starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else []
                for k, stop in zip(starts, [*starts[1:], len(r)]):
                    open_c = c[k:stop][free_c[cols[c[k:stop]]]]
                    take([(int(some[r[k]]), int(cols[open_c[0]]))] if len(open_c) else [])
            rows, cols = rows[free_r[rows]], cols[free_c[cols]]
    return out


class _Links:
    """The live tracklets of one piece: their numbers from 0 in the order in which they began, last frames and boxes."""

    def __init__(self, least: float, max_gap: int):
        self.least, self.max_gap = least, max_gap
        self.made = 0
        self.names, self.frames, self.boxes = np.zeros(0, int), np.zeros(0, int), np.zeros((0, 4))

    def step(self, frame: int, boxes: np.ndarray, alone: bool) -> np.ndarray:
        """The numbers of a frame's boxes, which are sorted. Boxes that overlap nothing are alone and begin a tracklet each."""
        out = np.full(len(boxes), -1)
        if not alone:
            live = frame - self.frames <= self.max_gap + 1
            self.names, self.frames, self.boxes = self.names[live], self.frames[live], self.boxes[live]
            for r, c in greedy_boxes(self.boxes, boxes, self.least):
                out[c] = self.names[r]
                self.frames[r], self.boxes[r] = frame, boxes[c]
        new = np.flatnonzero(out < 0)
        out[new] = self.made + np.arange(len(new))
        self.made += len(new)
        if not alone:
            self.names, self.frames, self.boxes = np.r_[self.names, out[new]], np.r_[self.frames, np.full(len(new), frame)], np.r_[self.boxes, boxes[new]]
        return out


def _joined(x: DataFrame, y: DataFrame, names: list[str]) -> DataFrame:
    """x with the other columns of y, which has one row at most for equal names; nulls are equal."""
    y = y.select(*(F.col(k).alias(f"_y_{k}") for k in names), *(c for c in y.columns if c not in names))
    return x.join(y, functools.reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_y_{k}")) for k in names)), "left").drop(*(f"_y_{k}" for k in names))


def _pieces(x: DataFrame, keys: list[str], least: float) -> DataFrame:
    """x with _piece: boxes of different pieces of a key can't overlap by least, as their widths shrunk by (1 - least) / (1 + least) don't touch. Pieces below 0 hold boxes that overlap nothing.

    Shrunk widths are joined by narrow strips in which they begin, so that a key's task sees at most so many rows.
    """
    if least <= 0:
        return x.withColumn("_piece", F.lit(0))
    box = ["x1", "y1", "x2", "y2"]
    whole = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    for c in box:
        whole = whole & (F.abs(F.col(c)) < float("inf"))
    half = (F.col("x2") - F.col("x1")) / 2 * ((1 - least) / (1 + least)) + 1e-9 * (F.abs("x1") + F.abs("x2"))
    middle = F.col("x1") / 2 + F.col("x2") / 2
    x = x.withColumn("_whole", whole).withColumn("_lo", F.when(whole, middle - half)).withColumn("_hi", F.when(whole, middle + half))
    ends = x.groupBy(*keys).agg(F.min("_lo").alias("_first"), F.max("_lo").alias("_last"))
    x = _joined(x, ends, keys)
    wide = F.greatest((F.col("_last") - F.col("_first")) / STRIPS, F.lit(1e-300))
    x = x.withColumn("_strip", F.least(F.floor((F.col("_lo") - F.col("_first")) / wide), F.lit(STRIPS)).cast("int")).drop("_first", "_last")
    strips = x.filter("_whole").groupBy(*keys, "_strip").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    w = Window.partitionBy(*keys).orderBy("_strip")
    reach = F.max("_hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    strips = strips.withColumn("_cut", F.coalesce((F.col("_lo") > reach).cast("int"), F.lit(0)))
    strips = strips.select(*keys, "_strip", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("_piece"))
    x = _joined(x, strips, [*keys, "_strip"])
    return x.withColumn("_piece", F.coalesce("_piece", -1 - F.pmod(F.hash("frame", *box), F.lit(64)))).drop("_whole", "_lo", "_hi", "_strip")


def tracklets(df: DataFrame, keys: list[str], least: float = 0.3, max_gap: int = 5) -> DataFrame:
    """keys, frame, x1, y1, x2, y2, tracklet: frame by frame, a key's boxes go greedily to the live tracklet that they overlap most, if by least; the others begin one.

    Tracklets are numbered by key in the order in which they begin, boxes of a frame by x1, y1, x2, y2; rows without a frame have -1. A key is cut into pieces between which no boxes overlap enough.
    They are dealt over all tasks; a task holds one Arrow batch, one frame of a piece and the piece's live tracklets, and at most so many pairs as CELLS says.
    """
    checkpoints(df.sparkSession)
    box = ["x1", "y1", "x2", "y2"]
    x = df.select(*keys, F.col("frame").cast("long").alias("frame"), *(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in box))
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    plain = f"{kinds}, frame long, x1 double, y1 double, x2 double, y2 double"
    piece = [*keys, "_piece"]

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, before, links = None, None, None

        def linked(rows: pd.DataFrame) -> pd.DataFrame:
            nonlocal before, links
            edge = _edges(rows, [*piece, "frame"])
            boxes, frames, pieces = rows[box].to_numpy(float), rows["frame"].to_numpy(), rows["_piece"].to_numpy()
            number, began = np.zeros(len(rows), int), np.zeros(len(rows), bool)
            heads = [tuple(None if pd.isna(v) else v for v in head) for head in rows[piece].iloc[edge[:-1]].itertuples(index=False)]
            for k, head in enumerate(heads):
                if links is None or head != before:
                    before, links = head, _Links(least, max_gap)
                start, stop = edge[k], edge[k + 1]
                made = links.made
                number[start:stop] = links.step(int(frames[start]), boxes[start:stop], pieces[start] < 0)
                began[start:stop] = number[start:stop] >= made
            return rows.assign(_number=number, _began=began)

        for batch in batches:
            rows = batch if rest is None or not len(rest) else pd.concat([rest, batch], ignore_index=True)
            last = _edges(rows, [*piece, "frame"])[-2] if len(rows) else 0  # its frame may go on in the next batch
            rest = rows.iloc[last:]
            if last:
                yield linked(rows.iloc[:last])
        if rest is not None and len(rest):
            yield linked(rest)

    cut = _pieces(x.filter(F.col("frame").isNotNull()), keys, least)
    cut = cut.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *piece).sortWithinPartitions(*piece, "frame", *box)
    folder = f"{df.sparkSession.sparkContext.getCheckpointDir()}/tracklets-{uuid.uuid4().hex}"
    cut.mapInPandas(go, f"{plain}, _piece int, _number long, _began boolean").write.parquet(folder)  # read twice below
    found = df.sparkSession.read.parquet(folder)
    began = found.filter("_began")
    counts = began.groupBy(*keys, "frame").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "frame", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    in_frame = Window.partitionBy(*keys, "frame").orderBy(*(F.coalesce(c, F.lit(float("nan"))) for c in box), "_piece", "_number")
    began = began.select(*piece, "_number", "frame", (F.row_number().over(in_frame) - 1).alias("_turn"))
    began = _joined(began, counts, [*keys, "frame"]).select(*piece, "_number", (F.col("_base") + F.col("_turn")).alias("tracklet"))
    out = _joined(found, began, [*piece, "_number"]).select(*keys, "frame", *box, "tracklet")
    return out.unionByName(x.filter(F.col("frame").isNull()).select(*keys, "frame", *(F.nanvl(c, F.lit(None)).alias(c) for c in box), F.lit(-1).cast("long").alias("tracklet")))
