"""Column expressions over boxes, points, slots, vectors and clocks. All stay inside code generation or array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frame_of(ts: str | Column, seconds: int = 3600) -> Column:
    """Whole periods since 1970, whatever the session's time zone."""
    name = ts if isinstance(ts, str) else ts._jc.toString()
    return F.floor(F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {name})") / F.lit(seconds)).cast("long")


def slot_label(object_class: Column, rank: Column) -> Column:
    return F.concat_ws("#", object_class, rank.cast("string"))


def class_of_slot(slot: Column) -> Column:
    return F.substring_index(slot, "#", 1)


def base_class(object_class: Column) -> Column:
    return F.regexp_replace(object_class, "_group$", "")


def box_area(b: Column) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def box_intersection(a: Column, b: Column) -> Column:
    wide = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    high = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    return wide * high


def box_iou(a: Column, b: Column) -> Column:
    """Null if a box is missing, 0 if both are empty."""
    common = box_intersection(a, b)
    union = box_area(a) + box_area(b) - common
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(union <= 0, 0.0).otherwise(common / union)


def box_containment(a: Column, b: Column) -> Column:
    """The share of the smaller box that lies in the other."""
    small = F.least(box_area(a), box_area(b))
    return F.when(small > 0, box_intersection(a, b) / small)


def box_centre(b: Column) -> Column:
    return F.array((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)


def box_clipped(b: Column, height: Column, width: Column, margin: float) -> Column:
    return (b[0] <= margin) | (b[1] <= margin) | (b[2] >= width - margin) | (b[3] >= height - margin)


def inside(point: Column, b: Column) -> Column:
    return point[0].between(b[0], b[2]) & point[1].between(b[1], b[3])


def to_pixels(b: Column, width: Column, height: Column) -> Column:
    """A normalised (x, y, width, height) box as corner pixels."""
    return F.array(b[0] * width, b[1] * height, (b[0] + b[2]) * width, (b[1] + b[3]) * height)


def full_to_crop(point: Column, crop: Column, scale: Column) -> Column:
    return F.array((point[0] - crop[0]) * scale, (point[1] - crop[1]) * scale)


def crop_to_full(point: Column, crop: Column, scale: Column) -> Column:
    return F.array(point[0] / scale + crop[0], point[1] / scale + crop[1])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def scaled_matrix(m: Column, scale: float, rows: int = 2) -> Column:
    """The first rows of a matrix scaled, the others as they are."""
    return F.transform(m, lambda r, i: F.when(i < rows, F.transform(r, lambda x: x * scale)).otherwise(r))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def first_reason(*rules: tuple[str, Column], otherwise: str | None = None) -> Column:
    """The reason of the first rule that holds."""
    out = None
    for reason, holds in rules:
        out = F.when(holds, reason) if out is None else out.when(holds, reason)
    return out.otherwise(F.lit(otherwise))


def strided(start: Column, count: Column, stride: int) -> Column:
    """start, start + stride, ... and the last frame."""
    return F.array_distinct(F.concat(F.sequence(start, start + count - 1, F.lit(stride)), F.array(start + count - 1)))


def path_matches(path: Column, pattern: str) -> Column:
    """/a/b matches itself, /a/** whatever lies below /a."""
    return path.startswith(pattern[:-2]) if pattern.endswith("/**") else path == pattern


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)
