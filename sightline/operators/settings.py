"""Search over grids of settings: every setting scored from counts of a grid, and chosen on all folds but one by what is left after taking that one away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.graph import checkpoints


def grid_counts(df: DataFrame, fold: list[str], truth: Column, axes: dict[str, list[float]]) -> DataFrame:
    """fold, a threshold for each axis, tp, found, positives: what each combination of thresholds lets through, where a row passes if it reaches all of them.

    The table is read once: a row counts in the cell of the highest thresholds that it reaches, and sums from high to low along one axis after the
    other make that the number of rows that reach a setting. A null value reaches none, a null truth is false. Thresholds are distinct and rising.
    """
    names = list(axes)
    for a, cuts in axes.items():
        if list(cuts) != sorted(set(cuts)):
            raise ValueError(f"{a}: thresholds must be distinct and rise")
    cell = {a: sum((F.coalesce(F.col(a) >= t, F.lit(False)).cast("int") for t in cuts), F.lit(0)) for a, cuts in axes.items()}
    hit = F.coalesce(truth, F.lit(False)).cast("long")
    counted = df.select(*fold, *(c.alias(f"_{a}") for a, c in cell.items()), hit.alias("_hit")).groupBy(*fold, *(f"_{a}" for a in names)).agg(F.sum("_hit").alias("tp"), F.count("*").alias("found"))
    checkpoints(df.sparkSession)
    counted = counted.withColumn("positives", F.sum("tp").over(Window.partitionBy(*fold))).checkpoint()  # a row for each fold and cell, read twice below
    grid = counted.groupBy(*fold).agg(F.first("positives").alias("positives"))
    for a in names:
        grid = grid.withColumn(f"_{a}", F.explode(F.sequence(F.lit(1), F.lit(len(axes[a])))))
    # A cell below the first threshold of any axis reaches no setting.
    same = [grid[k].eqNullSafe(counted[k]) for k in [*fold, *(f"_{a}" for a in names)]]
    x = grid.join(counted.select(*fold, *(f"_{a}" for a in names), "tp", "found"), same, "left").select(*(grid[c] for c in grid.columns), F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("found", F.lit(0)).alias("found"))
    for a in names:
        w = Window.partitionBy(*fold, *(f"_{b}" for b in names if b != a)).orderBy(F.col(f"_{a}").desc()).rowsBetween(Window.unboundedPreceding, 0)
        x = x.withColumn("tp", F.sum("tp").over(w)).withColumn("found", F.sum("found").over(w))
    return x.select(*fold, *(F.get(F.array(*(F.lit(float(t)) for t in axes[a])), F.col(f"_{a}") - 1).alias(a) for a in names), "tp", "found", "positives")


def chosen_settings(counts: DataFrame, fold: list[str], axes: list[str], objective: list[Column]) -> DataFrame:
    """fold, its axes' thresholds as chosen on all other folds, train_tp, train_found, train_positives and the fold's own tp, found and positives.

    objective has columns over tp, found and positives of the training folds, from the most important on, larger ones better; ties take the lowest thresholds.
    """
    all_folds = Window.partitionBy(*axes)
    totals = ["tp", "found", "positives"]
    x = counts.select(*fold, *axes, F.struct(*totals).alias("_own"), *((F.sum(c).over(all_folds) - F.col(c)).alias(c) for c in totals))
    order = [c.desc_nulls_last() for c in objective] + [F.col(a).asc() for a in axes]
    x = x.withColumn("_n", F.row_number().over(Window.partitionBy(*fold).orderBy(*order))).filter("_n = 1")
    return x.select(*fold, *axes, *(F.col(c).alias(f"train_{c}") for c in totals), *(F.col(f"_own.{c}").alias(c) for c in totals))
