"""Signed evidence that fades: which of two ends is meant, told from contributions by frame, with a sign that needs more to turn than to be set."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.matching import _edges
from sightline.streaming import ordered

COLUMNS = "frame long, contribution double, log_odds double, sign int, confidence double, episode long, in_episode double"


@dataclass(frozen=True)
class Rules:
    """keep: what is left of the log-odds after a frame; settle and turn: how far they must go to set a sign and to turn it; gap: frames without evidence after which an episode ends."""

    keep: float = 0.98
    settle: float = 2.0
    turn: float = 4.0
    gap: int = 30


@dataclass
class Evidence:
    """The state of one key. A new episode keeps log-odds and sign; only what it adds up by itself starts anew."""

    log_odds: float = 0.0
    sign: int = 0
    episode: int = 0
    in_episode: float = 0.0
    at: int | None = None

    def add(self, frame: int, contribution: float, rules: Rules) -> tuple:
        passed = 1 if self.at is None else frame - self.at
        if self.at is not None and passed > rules.gap:
            self.episode, self.in_episode = self.episode + 1, 0.0
        self.log_odds = self.log_odds * rules.keep**passed + contribution
        against = rules.settle if self.sign == 0 else rules.turn
        if abs(self.log_odds) > against:
            self.sign = 1 if self.log_odds > 0 else -1
        self.in_episode += contribution
        self.at = frame
        return frame, contribution, self.log_odds, self.sign, 1 / (1 + math.exp(-min(40.0, max(-40.0, self.log_odds)))), self.episode, self.in_episode


def _names() -> list[str]:
    return [c.split()[0] for c in COLUMNS.split(", ")]


def accumulated(df: DataFrame, keys: list[str], at: str, contribution: str, rules: Rules = Rules()) -> DataFrame:
    """keys and COLUMNS: a row for each frame of a key with evidence. Contributions of one frame add up first; null ones and rows without a frame don't count.

    A task goes through its keys in order, one Arrow batch at a time, and holds one key's state.
    """
    x = df.where(F.col(at).isNotNull() & F.col(contribution).isNotNull()).groupBy(*keys, F.col(at).cast("long").alias("frame")).agg(F.sum(contribution).cast("double").alias("contribution"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    typed = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, now = Evidence(), None
        for b in batches:
            out = []
            edge = _edges(b, keys)
            for start, stop in zip(edge[:-1], edge[1:]):
                key = tuple(None if v is None or v != v else v for v in b[keys].iloc[start])
                if key != now:
                    kept, now = Evidence(), key
                out += [kept.add(int(f), float(c), rules) for f, c in zip(b["frame"].iloc[start:stop], b["contribution"].iloc[start:stop])]
            yield pd.concat([b[keys].reset_index(drop=True), pd.DataFrame(out, columns=_names())], axis=1)

    return x.repartition(parts, *keys).sortWithinPartitions(*keys, "frame").mapInPandas(go, f"{typed}, {COLUMNS}")


def accumulated_stream(df: DataFrame, keys: list[str], at: str, contribution: str, rules: Rules = Rules(), late: int = 5, time: str | None = None, idle: str = "1 minute") -> DataFrame:
    """The same over a stream, frames in order and keys ended as streaming.ordered.fold says."""
    told = df.where(F.col(at).isNotNull() & F.col(contribution).isNotNull())

    def step(kept: Evidence, rows: pd.DataFrame) -> pd.DataFrame:
        sums = rows.groupby(at, sort=True)[contribution].sum()
        return pd.DataFrame([kept.add(int(f), float(c), rules) for f, c in sums.items()], columns=_names())

    return ordered.fold(told, keys, at, [at, contribution], Evidence, step, COLUMNS, late, time, idle)


def episodes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, episode, first, last, frames, total, peak_sign: what each episode added up, and the side it was on where it went furthest (the first time)."""
    furthest = F.max_by("in_episode", F.struct(F.abs("in_episode"), -F.col("frame")))
    return rows.groupBy(*keys, "episode").agg(
        F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("frames"), F.sum("contribution").alias("total"), F.signum(furthest).cast("int").alias("peak_sign")
    )
