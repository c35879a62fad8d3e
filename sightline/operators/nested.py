"""Equality of nested documents: VARIANT values taken apart into leaves with their paths, without keys that change from run to run.

A level is taken apart by one lateral explode, so no schema is needed and documents may differ in shape. Some levels follow each other in one pass over the rows;
only what is deeper still is cut from its lineage in the checkpoint folder. Digests add up over leaves and differences join them, so no document meets in one task.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators.graph import checkpoints


@dataclass(frozen=True)
class Volatile:
    """keys and suffixes of keys that go wherever they stand; paths ($.a.b[].c) that go; (pattern, replacement) pairs for texts."""

    keys: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    texts: tuple[tuple[str, str], ...] = ()

    def gone(self, key: Column, path: Column) -> Column:
        """A list's items have no key."""
        out = F.lit(False)
        if self.keys:
            out = out | key.isin(*self.keys)
        for s in self.suffixes:
            out = out | key.endswith(s)
        if self.paths:
            out = out | F.regexp_replace(path, r"\[\d+\]", "[]").isin(*self.paths)
        return F.coalesce(out, F.lit(False))

    def plain(self, text: Column) -> Column:
        for pattern, replacement in self.texts:
            text = F.regexp_replace(text, pattern, replacement)
        return text


LEVELS = 8  # so many levels are taken apart in one go


def leaves(df: DataFrame, keys: list[str], document: str, volatile: Volatile = Volatile(), deepest: int = 64) -> DataFrame:
    """keys, path, kind, value: one row for each scalar, null, empty object or empty list of a VARIANT column, but what is volatile.

    A missing document has no leaves. Numbers of different kinds (1 and 1.0) are different. A document deeper than deepest is an error.
    """
    checkpoints(df.sparkSession)
    spark = df.sparkSession
    rest = df.select(*keys, F.lit("$").alias("path"), F.col(document).alias("_v"))
    done = []
    while True:
        levels = min(LEVELS, deepest)
        for _ in range(levels):
            # What has nothing inside stays as it is, without a position.
            exploded = rest.select(*keys, F.col("path").alias("_path"), F.col("_v").alias("_w")).lateralJoin(spark.tvf.variant_explode_outer(F.col("_w").outer()))
            child = F.col("pos").isNotNull()
            step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.col("key"))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
            rest = exploded.select(*keys, F.when(child, F.concat("_path", step)).otherwise(F.col("_path")).alias("path"), F.when(child, F.col("value")).otherwise(F.col("_w")).alias("_v"), F.col("key").alias("_key"), child.alias("_child"))
            rest = rest.filter(~(F.col("_child") & volatile.gone(F.col("_key"), F.col("path"))))
        deepest -= levels
        kind = F.regexp_extract(F.schema_of_variant("_v"), "^[A-Z]+", 0)
        # A scalar string's JSON form has its quotes; its own text is what replacements see.
        value = F.when(F.col("kind") == "STRING", volatile.plain(F.try_variant_get("_v", "$", "string"))).otherwise(F.to_json("_v"))
        done.append(rest.filter(~F.col("_child") & F.col("_v").isNotNull()).withColumn("kind", kind).select(*keys, "path", "kind", value.alias("value")))
        deeper = rest.filter("_child").select(*keys, "path", "_v")  # the last level still had something inside
        if deeper.isEmpty():
            break
        if deepest <= 0:
            raise ValueError("a document is deeper than the deepest that was allowed")
        rest = deeper.checkpoint()
    return functools.reduce(DataFrame.unionByName, done)


def _sums(df: DataFrame, keys: list[str], document: str, volatile: Volatile) -> DataFrame:
    """keys, docs, leaves, _a, _b: how many documents and leaves a key has, and two sums of the leaves' hashes. One shuffle, of a few numbers for each document."""
    number = lambda seed: F.xxhash64(F.lit(seed), "path", "kind", "value").cast("decimal(20,0)")
    zero = F.lit(0).cast("decimal(20,0)")
    found = leaves(df, keys, document, volatile).select(*keys, F.lit(0).alias("docs"), F.lit(1).alias("leaves"), number(1).alias("_a"), number(2).alias("_b"))
    every = df.select(*keys, F.lit(1).alias("docs"), F.lit(0).alias("leaves"), zero.alias("_a"), zero.alias("_b"))
    return found.unionByName(every).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("docs", "leaves", "_a", "_b")))


def digests(df: DataFrame, keys: list[str], document: str, volatile: Volatile = Volatile()) -> DataFrame:
    """keys, leaves, digest: equal for documents that hold the same leaves, whatever the order of their keys. A document without leaves, missing ones too, has zeros."""
    return _sums(df, keys, document, volatile).select(*keys, "leaves", F.concat_ws("-", F.col("_a").cast("string"), F.col("_b").cast("string")).alias("digest"))


def differences(left: DataFrame, right: DataFrame, keys: list[str], document: str, volatile: Volatile = Volatile()) -> DataFrame:
    """keys, path, side ('left' or 'right' where only one has it, else 'both'), left, right: the leaves in which two sides' documents differ.

    Keys that have one document on both sides and equal sums of its leaves' hashes are out first; only what the other keys' documents hold is shuffled and joined.
    """
    checkpoints(left.sparkSession)
    mine, other = (_sums(x, keys, document, volatile) for x in (left, right))
    other = other.withColumnsRenamed({c: f"_r_{c}" for c in other.columns})
    same_key = functools.reduce(lambda p, q: p & q, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys))
    equal = F.lit(True)
    for c in ("docs", "leaves", "_a", "_b"):
        equal = equal & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    apart = mine.join(other, same_key, "full").filter(~(equal & (F.col("docs") == 1)))
    apart = apart.select(*(F.when(F.col("docs").isNotNull(), F.col(k)).otherwise(F.col(f"_r_{k}")).alias(f"_k_{k}") for k in keys)).checkpoint()
    theirs = functools.reduce(lambda p, q: p & q, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys))
    a, b = (leaves(x.join(apart, theirs, "left_semi"), keys, document, volatile) for x in (left, right))
    same = [a[k].eqNullSafe(b[k]) for k in [*keys, "path"]]
    x = a.join(b, same, "full")
    there = lambda s: s["path"].isNotNull()
    x = x.filter(~(a["kind"].eqNullSafe(b["kind"]) & a["value"].eqNullSafe(b["value"])))
    return x.select(
        *(F.coalesce(a[k], b[k]).alias(k) for k in keys), F.coalesce(a["path"], b["path"]).alias("path"),
        F.when(there(a) & there(b), "both").when(there(a), "left").otherwise("right").alias("side"), a["value"].alias("left"), b["value"].alias("right"),
    )
