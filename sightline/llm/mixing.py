"""Mixing sources to target weights by Pfair scheduling.

A source with weight w (its target over the sum of all targets, an exact fraction) owns block i from slot floor(i / w) on
and must get it out before slot ceil((i + 1) / w). One slot a block, earliest deadline first: every deadline is met,
and after any number of slots a source that has blocks left is less than one block away from its weight. The driver
schedules the blocks that there are, one step and 28 bytes for each; no task walks the schedule.

When a source has no blocks left the others go on within their own windows, so no document is dropped.
"""

from __future__ import annotations

import heapq
import math
from array import array
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.llm.native import spare, table

BLOCK = 64
BUCKET_ROWS = 20_000
BROADCAST_BLOCKS = 100_000
MOST_SOURCES = 100_000


def slots_of(weights: dict, period: int = 1000) -> dict:
    """Whole slots of a period by largest remainders of period times the share; a source may get none."""
    parts = {s: w * period for s, w in shares(weights).items()}
    out = {s: math.floor(x) for s, x in parts.items()}
    for s in sorted(parts, key=lambda s: (out[s] - parts[s], str(s)))[: period - sum(out.values())]:
        out[s] += 1
    return out


def exact(weight) -> Fraction:
    """A float counts as the decimal number that it is written as: 0.1 is a tenth."""
    return Fraction(str(weight))


def shares(weights: dict) -> dict:
    """{source: exact share} of the sources with a weight above 0; the shares add up to 1."""
    live = {s: exact(w) for s, w in weights.items() if w > 0}
    total = sum(live.values())
    return {s: w / total for s, w in live.items()}


def walk(weights: dict, blocks: dict):
    """(source, i, slot, release, deadline) of blocks[source] blocks of each source by slot, earliest deadline first. weights are exact and add up to 1.

    A slot in which no source that has blocks left may have one stays empty and costs nothing.
    """
    order = sorted(weights, key=str)
    parts = [(weights[s].numerator, weights[s].denominator) for s in order]
    coming = [(0, k, 0) for k, s in enumerate(order) if blocks[s]]
    ready: list = []
    slot = 0
    while coming or ready:
        if not ready:
            slot = max(slot, coming[0][0])
        while coming and coming[0][0] <= slot:
            release, k, i = heapq.heappop(coming)
            n, d = parts[k]
            heapq.heappush(ready, (-(-(i + 1) * d // n), k, i, release))
            if i + 1 < blocks[order[k]]:
                heapq.heappush(coming, ((i + 1) * d // n, k, i + 1))
        deadline, k, i, release = heapq.heappop(ready)
        yield order[k], i, slot, release, deadline
        slot += 1


def schedule(slots: dict) -> dict:
    """{(source, i): (slot, release, deadline)} of one period, earliest deadline first."""
    return {(s, i): (slot, release, deadline) for s, i, slot, release, deadline in walk(shares(slots), slots)}


def _plan(spark, weights: dict, blocks: dict, block: int, names: tuple) -> DataFrame:
    """A row for each block. Sources without a weight come after all others and take turns, one block a slot."""
    order = sorted(blocks, key=str)
    number = {s: k for k, s in enumerate(order)}
    keys, columns = array("i"), [array("q") for _ in range(4)]
    last = 0
    for s, *x in walk(weights, blocks):
        last = x[1] + 1
        if x[3] * block >= 2**62:
            raise ValueError(f"the weight of source {s[1:]!r} is too small: its places don't fit 64 bits")
        keys.append(number[s])
        for c, v in zip(columns, x):
            c.append(v)
    late = [s for s in order if s not in weights]
    for i in range(max((blocks[s] for s in late), default=0)):
        for s in late:
            if i < blocks[s]:
                keys.append(number[s])
                for c, v in zip(columns, (i, last, last, last + 1)):
                    c.append(v)
                last += 1
    source = pa.DictionaryArray.from_arrays(pa.array(np.array(keys, np.int32)), pa.array(order, pa.string())).cast(pa.string())
    made = pa.table([source, *(pa.array(np.array(c, np.int64)) for c in columns)], names=list(names))
    plan = spark.createDataFrame(made) if len(made) else spark.createDataFrame([], f"{names[0]} string, " + ", ".join(f"{c} long" for c in names[1:]))
    return F.broadcast(plan) if len(made) <= BROADCAST_BLOCKS else plan  # counted


def default_weights(counts: dict) -> dict:
    """The square root of the number of documents, which lifts small sources."""
    return {s: math.sqrt(n) for s, n in counts.items()}


def mix(docs: DataFrame, weights: dict | None = None, doc_id: str = "doc_id", source: str = "source", block: int = BLOCK, period: int = 1000, most_sources: int = MOST_SOURCES) -> DataFrame:
    """The columns of docs and mix_weight, mix_block, mix_release, mix_deadline, mix_slot, mix_position; the mixture is the order of mix_position.

    A null source is a source of its own. A source that weights leaves out, or gives 0, is put after all
    others. Documents of one source stand in the order of the MD5 of their id, a null id as an empty one. Repeated
    rows all stay, an empty table stays empty and texts aren't read. Columns of docs that have the names of the
    new ones are replaced, all others stay. Documents of a source are ranked in buckets, so a source may hold any
    share of the rows. The schedule of blocks must fit the driver, and more than most_sources sources are an error.
    Weights are taken as they are: period has no effect and stands for callers that still give one.
    """
    own = [f"mix_{c}" for c in ("weight", "block", "release", "deadline", "slot", "position")]
    x = docs.drop(*own)
    names = x.columns
    k, h, rank, bucket, before, size, w, number, slot, release, deadline = spare(
        [*names, *own], "key", "hash", "rank", "bucket", "before", "size", "share", "number", "at", "release", "deadline"
    )
    x = x.withColumn(k, F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))).withColumn(h, F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    rows = x.groupBy(k).agg(F.count("*").alias(size)).limit(most_sources + 1).collect()
    if len(rows) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    counts = {r[0]: r[1] for r in rows}
    digits = min(6, max(1, math.ceil(math.log(max(2, sum(counts.values()) / BUCKET_ROWS), 16)) + 1))
    x = x.withColumn(bucket, F.substring(h, 1, digits))
    given = default_weights(counts) if weights is None else {("n" if s is None else f"s{s}"): w for s, w in weights.items()}
    target = shares({s: given.get(s, 0) for s in counts})
    plan = _plan(docs.sparkSession, target, {s: -(-n // block) for s, n in counts.items()}, block, (k, number, slot, release, deadline))
    shares_of = docs.sparkSession.createDataFrame([(s, float(target.get(s, 0))) for s in counts], f"{k} string, {w} double")
    earlier = Window.partitionBy(k).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = x.groupBy(k, bucket).agg(F.count("*").alias(size)).select(k, bucket, F.coalesce(F.sum(size).over(earlier), F.lit(0)).alias(before))
    within = Window.partitionBy(k, bucket).orderBy(h, doc_id, *(c for c in names if c != doc_id and x.schema[c].dataType.simpleString() in ("string", "bigint", "int")))
    x = x.withColumn(rank, F.row_number().over(within) - 1).join(starts, [k, bucket])
    x = x.join(F.broadcast(shares_of), k).withColumn(rank, F.col(rank) + F.col(before))  # at most most_sources rows
    x = x.withColumn(number, F.floor(F.col(rank) / block)).join(plan, [k, number])
    made = (F.col(w), F.col(number), F.col(release), F.col(deadline), F.col(slot), F.col(slot) * block + F.col(rank) % block)
    return x.select(*names, *(c.alias(name) for c, name in zip(made, own)))


def op3_source_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document's place in the mixture. A null source is a source of its own, a null id counts as an empty one, repeated rows all have a place, texts aren't read and an empty table stays empty."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
