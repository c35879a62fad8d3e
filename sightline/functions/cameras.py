"""Column expressions over calibrated cameras, axes in one view, votes of cameras, and prompts as text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions.expressions import clamp, dot, norm
from sightline.functions.shapes import line_distance, minus, scaled, unit


@dataclass(frozen=True)
class Camera:
    """lens: fx, fy, cx, cy; bend: k1, k2, p1, p2, k3; turn: the nine values, row by row, that turn world into camera axes; shift is added after."""

    lens: Column
    bend: Column
    turn: Column
    shift: Column

    @property
    def centre(self) -> Column:
        return scaled(turned_back(self.turn, self.shift), F.lit(-1.0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often use names it."""
    return F.transform(F.array(value), use)[0]


def turned(turn: Column, p: Column) -> Column:
    return F.array(*(dot(F.slice(turn, 3 * i + 1, 3), p) for i in range(3)))


def turned_back(turn: Column, p: Column) -> Column:
    return F.array(*(turn[i] * p[0] + turn[3 + i] * p[1] + turn[6 + i] * p[2] for i in range(3)))


def turn_of(quaternion: Column) -> Column:
    """The nine values of a unit quaternion w, x, y, z."""

    def nine(q: Column) -> Column:
        w, x, y, z = (q[i] for i in range(4))
        return F.array(
            1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
            2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
            2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
        )

    return let(quaternion, nine)


def cross(a: Column, b: Column) -> Column:
    return F.array(*(a[j] * b[k] - a[k] * b[j] for j, k in ((1, 2), (2, 0), (0, 1))))


def turn_between(a: Column, b: Column) -> Column:
    """Degrees of the turn that leads from one to the other; exact for small turns too."""
    m = [[sum(a[3 * k + i] * b[3 * k + j] for k in range(3)) for j in range(3)] for i in range(3)]
    axis = F.array(m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1])
    return F.degrees(F.atan2(norm(axis), m[0][0] + m[1][1] + m[2][2] - 1))


def _bent(x: Column, y: Column, bend: Column) -> tuple[Column, Column, Column]:
    """The radial factor and what the tangential terms add."""
    r = x * x + y * y
    return 1 + r * (bend[0] + r * (bend[1] + r * bend[4])), 2 * bend[2] * x * y + bend[3] * (r + 2 * x * x), bend[2] * (r + 2 * y * y) + 2 * bend[3] * x * y


def seen_from(camera: Camera, point: Column) -> Column:
    """The point in camera axes; its third value is the depth."""
    return F.zip_with(turned(camera.turn, point), camera.shift, lambda a, b: a + b)


def project(camera: Camera, point: Column) -> Column:
    """The pixel [u, v] of a world point, as the lens bends it; null at depth 0."""

    def bent(d: Column) -> Column:
        far, dx, dy = _bent(d[0], d[1], camera.bend)
        return F.array(camera.lens[0] * (d[0] * far + dx) + camera.lens[2], camera.lens[1] * (d[1] * far + dy) + camera.lens[3])

    ahead = let(seen_from(camera, point), lambda p: F.when(p[2] != 0, F.array(p[0] / p[2], p[1] / p[2])))
    return let(ahead, lambda d: F.when(d.isNotNull(), bent(d)))


def straightened(camera: Camera, pixel: Column, rounds: int = 5) -> Column:
    """The direction [x, y] at depth 1 of a pixel, by rounds of taking the bend at the last guess away; NaN and null stay so."""

    def closer(first: Column, guess: Column) -> Column:
        far, dx, dy = _bent(guess[0], guess[1], camera.bend)
        return F.array((first[0] - dx) / far, (first[1] - dy) / far)

    flat = let(pixel, lambda p: F.array((p[0] - camera.lens[2]) / camera.lens[0], (p[1] - camera.lens[3]) / camera.lens[1]))
    return let(flat, lambda first: F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda guess, _: closer(first, guess)))


def ray(camera: Camera, pixel: Column) -> Column:
    """The unit direction in the world of a pixel's ray; it starts in the camera's centre."""
    return let(let(straightened(camera, pixel), lambda d: turned_back(camera.turn, F.array(d[0], d[1], F.lit(1.0)))), unit)


def epipolar_gap(centre: Column, direction: Column, camera: Camera, pixel: Column) -> Column:
    """Pixels, with the bend taken out, between a pixel and the line that another camera's ray draws in this view; null where that is no line."""

    def gap(n: Column, d: Column) -> Column:
        steep = F.sqrt(F.pow(n[0] / camera.lens[0], 2) + F.pow(n[1] / camera.lens[1], 2))
        return F.when(steep > 0, F.abs(n[0] * d[0] + n[1] * d[1] + n[2]) / steep)

    normal = let(seen_from(camera, centre), lambda c: let(turned(camera.turn, direction), lambda w: cross(c, w)))
    return let(normal, lambda n: let(straightened(camera, pixel), lambda d: gap(n, d)))


def plane_of_axis(camera: Camera, one: Column, other: Column) -> Column:
    """The plane through the camera's centre and two pixels: its unit normal and the normal's product with its points; null if both lie on one ray."""
    normal = let(ray(camera, one), lambda a: let(ray(camera, other), lambda b: cross(a, b)))
    return let(let(normal, lambda n: F.when(norm(n) >= 1e-9, unit(n))), lambda n: F.when(n.isNotNull(), F.struct(n.alias("normal"), dot(n, camera.centre).alias("offset"))))


def pixels_per_unit(camera: Camera, point: Column) -> Column:
    depth = seen_from(camera, point)[2]
    return F.when(depth > 0, (camera.lens[0] + camera.lens[1]) / 2 / depth)


def gate(base: Column | float, uncertainty: Column, camera: Camera, point: Column) -> Column:
    """A gate in pixels that grows with a point's uncertainty as this view shows it."""
    return F.lit(base) + uncertainty * pixels_per_unit(camera, point)


def line_cost(p: Column, u: Column, q: Column, v: Column, half: float, along: float = 0.5) -> Column:
    """Lines by midpoint and unit direction: how far apart, with what their angle moves an end at half their length and a share of the offset along the first."""
    m = line_distance(p, u, q, v)
    return m["apart"] + half * F.sin(F.radians(m["degrees"])) + along * F.abs(dot(minus(q, p), u))


def beyond_volume(point: Column, low: Column, high: Column) -> Column:
    """The most that any one axis lies outside the volume between two corners; negative inside."""
    return F.array_max(F.zip_with(F.zip_with(low, point, lambda a, x: a - x), F.zip_with(point, high, lambda x, b: x - b), lambda a, b: F.greatest(a, b)))


def box_on_end(start: Column, stop: Column, box: Column, reach: float, side: Column | None = None) -> Column:
    """A box that sits on one end of an axis in a view, or null.

    Its centre is at most reach beside the axis and not reach or more inside either end, and its near edge begins at most reach beyond the end. end is 0 or 1 (side,
    if given, must equal it), across, beyond (of the centre, negative inside) and gap (of the near edge) are pixels, to is where the axis ends with the box.
    """
    return let(minus(stop, start), lambda axis: let(unit(axis), lambda way: _on_end(start, norm(axis), way, box, reach, side)))


def _on_end(start: Column, length: Column, way: Column, box: Column, reach: float, side: Column | None) -> Column:
    along = lambda x, y: (x - start[0]) * way[0] + (y - start[1]) * way[1]
    x, y = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    at, across = along(x, y), F.abs((y - start[1]) * way[0] - (x - start[0]) * way[1])
    reached = [along(box[i], box[j]) for i in (0, 2) for j in (1, 3)]
    low, high = F.least(*reached), F.greatest(*reached)
    last = at >= length / 2
    gap = F.when(last, low - length).otherwise(-high)
    far = F.when(last, F.greatest(high, length)).otherwise(F.least(low, F.lit(0.0)))
    end = F.when(last, 1).otherwise(0)
    fits = (length >= 1e-9) & (across <= reach) & ~((at >= reach) & (at <= length - reach)) & (gap <= reach)
    if side is not None:
        fits = fits & (side.isNull() | (side == end))
    to = F.zip_with(start, way, lambda s, w: s + far * w)
    return F.when(fits, F.struct(end.alias("end"), across.alias("across"), F.when(last, at - length).otherwise(-at).alias("beyond"), gap.alias("gap"), to.alias("to")))


def taper_vote(first: Column, second: Column, tail: Column, wide_is_tip: Column, residual: Column, swapped: Column, least: float, full: float, trusted: float, worst: float) -> Column:
    """One view's vote, by the widths at both ends and the end with the longer tail, for the end that is the tip.

    The wider end is the butt unless wide_is_tip; its confidence is 0 at a ratio of least and 1 at full. The tail counts with trusted, not where wide_is_tip. Votes
    that differ, an axis residual beyond worst and an axis in unknown order (swapped is null) give null.
    """
    small, large = F.least(first, second), F.greatest(first, second)
    sure = F.when(small > 0, clamp((large / small - least) / (full - least), 0.0, 1.0))
    widest = F.when(first > second, 0).otherwise(1)
    by_width = F.when(first.isNotNull() & second.isNotNull() & (sure > 0), F.when(wide_is_tip, widest).otherwise(1 - widest))
    by_tail = F.when(~wide_is_tip, tail)
    counts = swapped.isNotNull() & (residual.isNull() | (residual <= worst)) & F.coalesce(by_width == by_tail, F.lit(True))
    end, weight = F.coalesce(by_width, by_tail), F.greatest(F.when(by_width.isNotNull(), sure), F.when(by_tail.isNotNull(), trusted))
    return F.when(counts & end.isNotNull(), F.struct(F.when(swapped, 1 - end).otherwise(end).alias("end"), weight.alias("confidence")))


def confidence(state: Column, support: Column, views: Column, residual: Column, disputed: Column, unseen: Column, coasting: tuple[str, ...], limit: int, reach: float, least: float) -> Column:
    """A track's confidence and whether to abstain: by its share of views, its median residual against reach and disputes over its slot; halved and falling while unseen."""
    seen = F.round(F.least(support / F.greatest(views, F.lit(2)), F.lit(1.0)) * clamp(1 - F.coalesce(residual, F.lit(0.0)) / reach, 0.0, 1.0) * F.when(disputed, 0.5).otherwise(1.0), 3)
    fading = F.round(0.5 * F.greatest(F.lit(0.0), 1 - unseen / max(1, limit)), 3)
    value = F.when(state == "lost", 0.0).when(state.isin(*coasting), fading).otherwise(seen)
    return F.struct(value.alias("confidence"), ((state != "observed") | disputed | (value < least)).alias("abstain"))


def prompt(text: Column) -> Column:
    """target=x1,y1,x2,y2 with ;fg=x,y and ;bg=x,y after it, any number; null for any other text."""
    number = r"\s*[+-]?\d+\s*"
    parts = F.split(text, ";")
    numbers = lambda t: F.transform(F.split(F.substring_index(t, "=", -1), ","), lambda x: F.trim(x).try_cast("int"))
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    right = parts[0].rlike(f"^[^=]+={number},{number},{number},{number}$") & F.forall(rest, lambda t: t.rlike(f"^(fg|bg)={number},{number}$"))
    marks = lambda kind: F.transform(F.filter(rest, lambda t: t.startswith(kind + "=")), numbers)
    return F.when(right, F.struct(F.trim(F.substring_index(parts[0], "=", 1)).alias("target"), numbers(parts[0]).alias("box"), marks("fg").alias("fg"), marks("bg").alias("bg")))


def named_path(item: Column) -> Column:
    """name=path, or a path named by its file, or by its folder where the file is tracks.jsonl."""
    name, after = F.trim(F.substring_index(item, "=", 1)), F.trim(F.regexp_extract(item, "^[^=]*=(.*)$", 1))
    given = item.contains("=") & ~name.rlike("^[/.]") & ~name.contains("/")
    path = F.when(given, after).otherwise(F.trim(item))
    parts = F.split(path, "/")
    file = F.element_at(parts, -1)
    folder = F.when(F.size(parts) > 1, F.element_at(parts, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise("")
    return F.struct(F.when(given, name).when(file == "tracks.jsonl", folder).otherwise(F.regexp_replace(file, r"(?<=.)\.[^.]*$", "")).alias("name"), path.alias("path"))
