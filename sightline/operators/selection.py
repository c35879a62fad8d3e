"""Which rows to look at: quotas over strata that hand on what they can't fill, and spaced picks in phases.

Rank limits come first, and Spark applies them in every partition before it shuffles, so a hot group or stratum sends no more rows than could be picked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drawn(seed: int, *columns: str) -> Column:
    """A seeded order by hash: the same rows are drawn wherever and however often it is made."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))


def quotas(df: DataFrame, group: list[str], stratum: str, row: list[str], n: int, seed: int = 0) -> DataFrame:
    """df's rows that a draw of n for each group takes, spread evenly over the group's strata; a stratum short of its share hands the rest on to the others.

    A share is n / strata, rounded up; where all fill theirs, the last strata lose what is over. row names a row; rows of one name tie. Null strata are one stratum.
    """
    w = Window.partitionBy(*group, stratum).orderBy("_draw", *row)
    x = df.withColumn("_draw", drawn(seed, *group, stratum, *row)).withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n)
    own = Window.partitionBy(*group)
    x = x.withColumn("_dense", F.dense_rank().over(own.orderBy(F.col(stratum).asc_nulls_first()))).withColumn("_strata", F.max("_dense").over(own))
    over = F.col("_rank") > F.ceil(F.lit(n) / F.col("_strata"))
    order = own.orderBy(over, F.when(~over, F.col("_dense")), F.when(~over, F.col("_rank")), "_draw", *row)
    return x.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= n).select(*df.columns)


@dataclass(frozen=True)
class Phase:
    """name, which rows may be picked, in what order (columns, each with whether it falls; ties by place), and how many at most."""

    name: str
    among: Column
    order: list[tuple[Column, bool]]
    most: int


def spaced(df: DataFrame, keys: list[str], at: str, spacing: int, phases: list[Phase], given: str | None = None) -> DataFrame:
    """keys, at, phase, turn: picks of each phase in its order, every one at least spacing from all others; turn counts them.

    given, an array column, holds places that are taken from the start (phase 'given'); the rows of a key have the same one. A place counts once a phase, by its first row. All phases together pick few places and each
    rules out fewer than 2 * spacing, so only that many rows of a phase's order can matter; the rest never leave their partition.
    """
    least = sum(p.most for p in phases)
    gone = 2 * spacing - 1
    taken = F.col(given) if given else F.array().cast("array<long>")
    given_places = F.array_distinct(F.coalesce(taken.cast("array<long>"), F.array().cast("array<long>")))
    x = df.filter(F.col(at).isNotNull()).select(*keys, F.col(at).cast("long").alias("_at"), given_places.alias("_given"), *(p.among.alias(f"_among{i}") for i, p in enumerate(phases)), *(c.alias(f"_order{i}_{k}") for i, p in enumerate(phases) for k, (c, _) in enumerate(p.order)))
    most_given = 0 if given is None else x.agg(F.max(F.size("_given"))).first()[0] or 0
    need = (least + most_given) * gone
    parts = []
    for i, p in enumerate(phases):
        order = [F.col(f"_order{i}_{k}").desc() if falls else F.col(f"_order{i}_{k}").asc() for k, (_, falls) in enumerate(p.order)]
        own = x.filter(f"_among{i}")
        best = own.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_at").orderBy(*order))).filter("_n = 1")
        best = best.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "_at"))).filter(F.col("_n") <= need)
        parts.append(best.select(*keys, "_given", F.lit(i).alias("_phase"), "_n", "_at"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    lists = rows.groupBy(*keys).agg(F.first("_given").alias("_given"), F.array_sort(F.collect_list(F.struct("_phase", "_n", "_at"))).alias("_rows"))
    pick = "array<struct<at:long,phase:int>>"
    start = F.transform("_given", lambda g: F.struct(g.alias("at"), F.lit(-1).alias("phase"))).cast(pick)
    limit = F.array(*(F.lit(p.most) for p in phases))

    def step(chosen: Column, r: Column) -> Column:
        room = F.size(F.filter(chosen, lambda c: c["phase"] == r["_phase"])) < F.get(limit, r["_phase"])
        free = F.forall(chosen, lambda c: F.abs(c["at"] - r["_at"]) >= spacing)
        return F.when(room & free, F.concat(chosen, F.array(F.struct(r["_at"].alias("at"), r["_phase"].alias("phase"))).cast(pick))).otherwise(chosen)

    names = F.array(F.lit("given"), *(F.lit(p.name) for p in phases))
    out = lists.select(*keys, F.posexplode(F.aggregate("_rows", start, step)).alias("_turn", "_pick"))
    return out.select(*keys, F.col("_pick.at").alias(at), F.get(names, F.col("_pick.phase") + 1).alias("phase"), (F.col("_turn") + 1).cast("long").alias("turn"))
