"""Column expressions over points, lines, planes, polygons, cue scores, view names and clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions.expressions import clamp, dot, norm


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def unit(a: Column) -> Column:
    """Null for a vector without length."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x / length))


def angle(a: Column, b: Column, unoriented: bool = False) -> Column:
    """Degrees between two vectors, at most 90 if they are unoriented; null if one has no length."""
    c = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.when(c.isNotNull(), F.degrees(F.acos(clamp(F.abs(c) if unoriented else c, -1.0, 1.0))))


def above_plane(point: Column, normal: Column, offset: Column) -> Column:
    return dot(normal, point) - offset


def on_ray(origin: Column, direction: Column, near: Column) -> Column:
    """The point of the line through origin along a unit direction that is closest to near."""
    return F.zip_with(origin, scaled(direction, dot(minus(near, origin), direction)), lambda x, y: x + y)


def off_line(point: Column, origin: Column, direction: Column) -> Column:
    return norm(minus(point, on_ray(origin, direction, point)))


def line_distance(p: Column, u: Column, q: Column, v: Column) -> Column:
    """Of two lines by midpoint and unit direction: degrees between them, the mean distance of each midpoint from the other line, and between the midpoints."""
    return F.struct(angle(u, v, True).alias("degrees"), ((off_line(q, p, u) + off_line(p, q, v)) * 0.5).alias("apart"), norm(minus(p, q)).alias("middles"))


def along_across(anchor: Column, end: Column, other: Column) -> Column:
    """How far the anchor lies beyond a segment's end along its axis (negative: short of it), and beside the axis; null for a segment without length."""
    axis, offset = minus(end, other), minus(anchor, end)
    way = unit(axis)
    along = dot(offset, way)
    return F.when(norm(axis) > 1e-9, F.struct(along.alias("along"), norm(minus(offset, scaled(way, along))).alias("across")))


def inside_convex(point: Column, polygon: Column) -> Column:
    """Whether all edges see the point on one side, whichever way round they go; a polygon of fewer than three corners holds nothing."""
    after = F.concat(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), F.slice(polygon, 1, 1))
    side = F.zip_with(polygon, after, lambda a, b: (b[0] - a[0]) * (point[1] - a[1]) - (b[1] - a[1]) * (point[0] - a[0]))
    return (F.size(polygon) >= 3) & (F.forall(side, lambda s: s >= -1e-9) | F.forall(side, lambda s: s <= 1e-9))


def to_box(point: Column, box: Column) -> Column:
    """Distance to a box, 0 inside."""
    dx = F.greatest(box[0] - point[0], F.lit(0.0), point[0] - box[2])
    dy = F.greatest(box[1] - point[1], F.lit(0.0), point[1] - box[3])
    return F.sqrt(dx * dx + dy * dy)


def clamped_interval(low: Column, high: Column, seen_low: Column, seen_high: Column, most: float) -> Column:
    """An interval cut to at most most, from the end that fewer views see; by half at both ends when as many see each."""
    middle = (low + high) * 0.5
    start = F.when(seen_low > seen_high, low).when(seen_high > seen_low, high - most).otherwise(middle - most / 2)
    cut = high - low > most
    return F.struct(F.when(cut, start).otherwise(low).alias("low"), F.when(cut, F.when(seen_low > seen_high, low + most).when(seen_high > seen_low, high).otherwise(middle + most / 2)).otherwise(high).alias("high"), cut.alias("cut"))


def contact_ramp(distance: Column, reach: float = 24.0) -> Column:
    """1 at contact, falling to 0 at reach; 0 without a distance."""
    return F.when(distance <= reach, 1.0 - distance / reach).otherwise(0.0)


def fused(scores: Column, *terms: tuple[Column, float]) -> Column:
    """An array of scores with weighted terms of the whole row added to each."""
    added = sum((term * weight for term, weight in terms[1:]), terms[0][0] * terms[0][1])
    return F.transform(scores, lambda s: s + added)


def conditioned(scores: Column, first: int, last: int, prior: Column) -> Column:
    """scores with a prior added from the place first to before last, counted from 0."""
    return F.transform(scores, lambda s, i: F.when((i >= first) & (i < last), s + prior).otherwise(s))


def view_of(view_id: Column) -> Column:
    """static-c1 is C1, ego-hmc2 is HMC_2."""
    rest = F.regexp_extract(view_id, "^[^-]*-(.*)$", 1)
    return F.when(F.substring_index(view_id, "-", 1) == "ego", F.concat(F.lit("HMC_"), F.upper(F.regexp_replace(rest, "^hmc", "")))).otherwise(F.upper(rest))


def seconds_of(text: Column) -> Column:
    """The comma-separated seconds of a text, in their order; null unless there are some and all are numbers, not negative and increasing."""
    parts = F.transform(F.filter(F.split(text, ","), lambda p: F.trim(p) != ""), lambda p: F.trim(p).try_cast("double"))
    rising = F.aggregate(parts, F.struct(F.lit(True).alias("ok"), F.lit(-1.0).alias("last")), lambda s, x: F.struct((s.ok & x.isNotNull() & (x >= 0) & (x > s.last)).alias("ok"), x.alias("last")), lambda s: s.ok)
    return F.when((F.size(parts) > 0) & rising, parts)


def relative_to(path: Column, root: str) -> Column:
    """The path below root, or the path as it is where it lies elsewhere."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(path)


def source_seconds(frame: Column, fps: float, offset: float = 0.0, scale: float = 1.0) -> Column:
    """The second of the source at a frame; null before the first."""
    return F.when(frame >= 0, offset + scale * (frame / fps))
