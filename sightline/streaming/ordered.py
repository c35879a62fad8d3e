"""Folds over the rows of a key in the order of their frames, in a stream whose rows come late and whose keys end."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def fold(
    df: DataFrame, keys: list[str], at: str, columns: list[str], start: Callable, step: Callable, schema: str, late: int = 5, time: str | None = None, idle: str = "1 minute"
) -> DataFrame:
    """What step(state, rows) returns for a key's rows whose frames are whole, by rising frames; state is start() at first, is changed in place and kept between micro-batches.

    A frame is taken once one more than late frames younger has come, so rows may be that late; older rows are passed over. With time, a timestamp
    column that has a watermark, a key is over once the watermark is idle past its youngest row: its last frames are taken and its state goes. Rows
    that come after a key's end begin it anew. Without time the last late + 1 frames wait for rows that may never come. step gets a frame of columns, at among
    them, and returns one without keys; schema says what its columns are.
    """
    rest = int(pd.Timedelta(idle).total_seconds() * 1000)
    typed = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    names = [c.strip().split()[0].strip("`") for c in schema.split(",")]

    def one(key, batches, state):
        mine, waiting, last, youngest = pickle.loads(state.get[0]) if state.exists else (start(), pd.DataFrame(columns=columns), None, 0)
        if state.hasTimedOut:
            state.remove()
            out = step(mine, waiting.sort_values(columns)) if len(waiting) else pd.DataFrame(columns=names)
        else:
            new = list(batches)
            rows = pd.concat([x for x in (waiting, *(b[columns] for b in new)) if len(x)] or [waiting], ignore_index=True)
            rows = rows if last is None else rows[rows[at] > last]
            ready = rows[rows[at] < rows[at].max() - late] if len(rows) else rows
            last = int(ready[at].max()) if len(ready) else last
            out = step(mine, ready.sort_values(columns)) if len(ready) else pd.DataFrame(columns=names)
            if time:
                youngest = max([youngest, *(int(b[time].max().timestamp() * 1000) for b in new if b[time].notna().any())])
                state.setTimeoutTimestamp(max(youngest + rest, state.getCurrentWatermarkMs() + 1))
            state.update((pickle.dumps((mine, rows.drop(ready.index), last, youngest)),))
        for k, v in zip(keys, key):
            out[k] = v
        yield out[[*keys, *names]]

    grouped = df.select(*keys, *columns, *([time] if time else [])).groupBy(*keys)
    return grouped.applyInPandasWithState(one, f"{typed}, {schema}", "kept binary", "append", "EventTimeTimeout" if time else "NoTimeout")
