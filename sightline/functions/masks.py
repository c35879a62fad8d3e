"""Masks as arrays of distinct pixel numbers (row * width + column), and frame lists as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(mask: Column) -> Column:
    """Set pixels; 0 for a missing mask."""
    return F.when(mask.isNull(), 0).otherwise(F.size(mask)).cast("long")


def centroid(mask: Column, width: int, pixel_centre: bool = False) -> Column:
    """[x, y] of the mean pixel, half a pixel further with pixel_centre; null for an empty or missing mask."""
    n, half = F.size(mask), 0.5 if pixel_centre else 0.0
    x = F.aggregate(mask, F.lit(0).cast("long"), lambda acc, p: acc + F.pmod(p, F.lit(width)))
    y = F.aggregate(mask, F.lit(0).cast("long"), lambda acc, p: acc + F.floor(p / width))
    return F.when(n > 0, F.array(x / n + half, y / n + half))


def iou(a: Column, b: Column, empty: float | None = None) -> Column:
    """Shared by all pixels; null if a mask is missing, empty where both hold nothing."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(either > 0, both / either).otherwise(F.lit(empty).cast("double")))


def agreement(a: Column, b: Column) -> Column:
    """iou where a mask that only one side has counts as 0; null where both are missing or empty."""
    left, right = (F.coalesce(x, F.array().cast("array<long>")) for x in (a, b))
    return iou(left, right)


def overlap(mask: Column, region: Column, empty: float = 0.0) -> Column:
    """Share of the mask that lies in the region; empty for a mask without pixels."""
    return F.when(F.size(mask) > 0, F.size(F.array_intersect(mask, region)) / F.size(mask)).otherwise(F.lit(empty))


def overlap_union(mask: Column, regions: list[Column], empty: float = 0.0) -> Column:
    """Share of the mask in any of the regions; missing regions hold nothing."""
    together = F.array_distinct(F.concat(*(F.coalesce(r, F.array().cast("array<long>")) for r in regions)))
    return overlap(mask, together, empty)


def frame_list(spec: Column) -> Column:
    """Sorted distinct frames of comma-separated tokens: n, a-b with both ends, a:b:s without b. A null spec is null."""

    def one(token: Column) -> Column:
        t = F.trim(token)
        part = F.split(t, "[:-]")
        number = lambda i: F.try_element_at(part, F.lit(i)).cast("long")
        strided = F.when(number(2) > number(1), F.sequence(number(1), number(2) - 1, number(3))).otherwise(F.array().cast("array<long>"))
        return F.when(t == "", F.array().cast("array<long>")).when(t.contains(":"), strided).when(t.contains("-"), F.sequence(number(1), number(2))).otherwise(F.array(number(1)))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(spec, ","), one))))
