"""Summaries at several grains, votes, histograms, contingency and stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.operators.graph import checkpoints
from sightline.operators.windows import first_of


def multi_grain(df: DataFrame, grains: list[list[str]], **measures: Column) -> DataFrame:
    """One row for each group of each grain, from one pass; keys that a grain leaves out are null and grain names the kept ones."""
    keys = list(dict.fromkeys(k for g in grains for k in g))
    out = df.groupingSets([[df[k] for k in g] for g in grains], *(df[k] for k in keys)).agg(*(m.alias(n) for n, m in measures.items()), *(F.grouping(k).alias(f"_{k}") for k in keys))
    grain = F.concat_ws("+", *(F.when(F.col(f"_{k}") == 0, k) for k in keys))
    return out.withColumn("grain", grain).drop(*(f"_{k}" for k in keys))


def quantiles(value: str, **at: float) -> list[Column]:
    """Linearly interpolated percentiles, one column each."""
    return [F.percentile(value, F.lit(p)).alias(n) for n, p in at.items()]


ACCURACY = 10_000  # a sketch errs by one rank in so many
FEW = 10_000  # groups whose sketches are broadcast; the rows are shuffled to those of more groups


def ranked_quantiles(df: DataFrame, keys: list[str], value: str, **at: float) -> DataFrame:
    """keys, n (rows), one column for each exact linearly interpolated percentile, as quantiles has them, for groups of any size.

    A sketch of each group brackets the ranks, exact counts tell where each bracket lies, and only the equal values inside are counted and sorted. A bracket that
    misses its ranks is opened on that side, so the sketch decides the work and never the result.
    """
    x = df.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(value).cast("double").alias("_v"))
    groups, shares = [f"_k{i}" for i in range(len(keys))], list(at.values())

    def joined(y: DataFrame) -> DataFrame:
        """The rows with what y has for their group."""
        y = y.withColumnsRenamed({k: f"_y{k}" for k in groups})
        same = F.lit(True)
        for k in groups:
            same = same & F.col(k).eqNullSafe(F.col(f"_y{k}"))
        return x.join(F.broadcast(y) if few else y, same).drop(*(f"_y{k}" for k in groups))

    checkpoints(df.sparkSession)
    ends = F.array(*(F.lit(min(1.0, max(0.0, p + d / ACCURACY))) for p in shares for d in (-2, 2)))
    sketch = x.groupBy(*groups).agg(F.percentile_approx("_v", ends, F.lit(ACCURACY)).alias("_ends")).checkpoint()
    few = sketch.count() <= FEW
    v, end = F.col("_v"), lambda i: F.get("_ends", F.lit(i))
    counts = joined(sketch).groupBy(*groups).agg(
        F.count("*").alias("n"), F.count("_v").alias("_n"), F.first("_ends").alias("_ends"), F.array(*(F.count_if(v < end(2 * i)) for i in range(len(at)))).alias("_below"), F.array(*(F.count_if(v <= end(2 * i + 1)) for i in range(len(at)))).alias("_upto"),
    )
    place = [(F.col("_n") - 1) * F.lit(float(p)) for p in shares]
    brackets = []
    for i, p in enumerate(place):
        below, upto = F.get("_below", F.lit(i)), F.get("_upto", F.lit(i))
        fits = below <= F.floor(p)
        brackets.append(F.struct(F.when(fits, end(2 * i)).alias("low"), F.when(upto > F.ceil(p), end(2 * i + 1)).alias("high"), F.when(fits, below).otherwise(0).alias("below"), p.alias("place")))
    told = counts.select(*groups, "n", F.array(*brackets).alias("_b")).checkpoint()
    inside = [F.when((F.get("_b", F.lit(i))["low"].isNull() | (v >= F.get("_b", F.lit(i))["low"])) & (F.get("_b", F.lit(i))["high"].isNull() | (v <= F.get("_b", F.lit(i))["high"])), F.lit(i)) for i in range(len(at))]
    some = joined(told.select(*groups, "_b")).filter(v.isNotNull()).select(*groups, "_v", F.explode(F.array_compact(F.array(*inside))).alias("_i"))
    some = some.groupBy(*groups, "_i", "_v").agg(F.count("*").alias("_c"))
    some = some.withColumn("_to", F.sum("_c").over(Window.partitionBy(*groups, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    some = some.withColumnsRenamed({k: f"_s{k}" for k in groups})
    same = F.lit(True)
    for k in groups:
        same = same & F.col(k).eqNullSafe(F.col(f"_s{k}"))
    ranked = told.join(some, same, "left").withColumn("_b", F.get("_b", F.col("_i")))
    to = F.col("_b.below") + F.col("_to")
    has = lambda rank: (to - F.col("_c") <= rank) & (rank < to)
    place = F.col("_b.place")
    low, high = F.max(F.when(has(F.floor(place)), F.col("_v"))), F.max(F.when(has(F.ceil(place)), F.col("_v")))
    found = ranked.groupBy(*groups, "n", "_i", place.alias("_p")).agg(low.alias("_low"), high.alias("_high"))
    drawn = F.when(F.col("_low").eqNullSafe(F.col("_high")), F.col("_low")).otherwise((F.ceil("_p") - F.col("_p")) * F.col("_low") + (F.col("_p") - F.floor("_p")) * F.col("_high"))
    out = found.groupBy(*groups, "n").agg(*(F.max(F.when(F.col("_i") == i, drawn)).alias(name) for i, name in enumerate(at)))
    return out.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), "n", *at)


def weighted_vote(df: DataFrame, keys: list[str], choice: str, weight: str) -> DataFrame:
    """keys, winner, share, entropy (bits), votes: ties go to the alphabetically first choice."""
    per = df.groupBy(*keys, choice).agg(F.sum(weight).alias("_w"))
    total = per.groupBy(*keys).agg(F.sum("_w").alias("_t"), F.count("*").alias("votes"))
    x = per.join(total, keys).withColumn("_p", F.col("_w") / F.col("_t"))
    entropy = x.groupBy(*keys).agg(F.sum(F.when(F.col("_p") > 0, -F.col("_p") * F.log2("_p")).otherwise(0.0)).alias("entropy"))
    top = first_of(x, keys, F.col("_w").desc(), F.col(choice).asc()).select(*keys, F.col(choice).alias("winner"), F.col("_p").alias("share"), "votes")
    return top.join(entropy, keys)


def plurality(df: DataFrame, keys: list[str], choice: str, decisive: float | None = None) -> DataFrame:
    """keys, winner, n, of: the most frequent choice, ties alphabetical. With decisive, null unless it holds that share."""
    per = df.groupBy(*keys, choice).agg(F.count("*").alias("n"))
    x = per.withColumn("of", F.sum("n").over(Window.partitionBy(*keys)))
    x = first_of(x, keys, F.col("n").desc(), F.col(choice).asc())
    winner = F.col(choice) if decisive is None else F.when(F.col("n") >= decisive * F.col("of"), F.col(choice))
    return x.select(*keys, winner.alias("winner"), "n", "of")


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """bin, n over half-open bins [edge, next), the last one open; values below the first edge are bin -1. Every bin has a row."""
    b = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(value))) - 1
    counts = df.filter(F.col(value).isNotNull()).groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(len(edges)).withColumnRenamed("id", "bin")
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def fixed_categories(df: DataFrame, keys: list[str], category: str, values: list[str]) -> DataFrame:
    """A row for every key and every listed category, 0 where there is none."""
    counts = df.groupBy(*keys, category).agg(F.count("*").alias("n"))
    grid = df.select(*keys).distinct().withColumn(category, F.explode(F.array(*map(F.lit, values))))
    return grid.join(counts, [*keys, category], "left").select(*keys, category, F.coalesce("n", F.lit(0)).alias("n"))


def switches(df: DataFrame, keys: list[str], order: list[str], identity: str) -> DataFrame:
    """keys, switches, seen: how often the identity differs from the last known one."""
    x = df.filter(F.col(identity).isNotNull()).withColumn("_last", F.lag(identity).over(Window.partitionBy(*keys).orderBy(*order)))
    return x.groupBy(*keys).agg(F.sum((F.col(identity) != F.col("_last")).cast("int")).alias("switches"), F.count("*").alias("seen")).na.fill(0, ["switches"])


def stability(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """keys, steps, median_step: the median relative change between neighbouring steps that both have a value above 0."""
    w = Window.partitionBy(*keys).orderBy(at)
    x = df.withColumn("_p", F.lag(value).over(w)).withColumn("_t", F.lag(at).over(w))
    step = F.when((F.col(at) - F.col("_t") == 1) & (F.col("_p") > 0) & (F.col(value) > 0), F.abs(F.col(value) - F.col("_p")) / F.col("_p"))
    return x.withColumn("_s", step).groupBy(*keys).agg(F.count("_s").alias("steps"), F.percentile("_s", F.lit(0.5)).alias("median_step"))


def contingency(df: DataFrame, row: str, column: str) -> DataFrame:
    """row, column, n, row_n, column_n, of pairs; a row value over several columns is a split, a column over several rows a merge."""
    cells = df.groupBy(row, column).agg(F.count("*").alias("n"))
    return cells.withColumn("row_n", F.sum("n").over(Window.partitionBy(row))).withColumn("column_n", F.sum("n").over(Window.partitionBy(column)))


def paired(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, left, right, delta over the keys that both sides hold."""
    x = a.select(*keys, F.col(value).alias("left")).join(b.select(*keys, F.col(value).alias("right")), keys)
    return x.withColumn("delta", F.col("right") - F.col("left"))


def tri_state(*conditions: Column) -> Column:
    """Whether all conditions hold; null as soon as one is unknown and none is false."""
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
