"""Multi-view identity tracker: a state machine over frames of observations from several cameras.

An observation is (view, object_class, u, v). Each frame: live tracks are predicted, observations go greedily to the nearest
projected track of their class in its gate (one for each track and view), tracks with two or more views are triangulated and
blended, tracks with one keep their place, tracks with none coast until they time out. What is left over forms candidates from views
that agree; a candidate that fits exactly one coasting track of its class, which fits no other candidate, resumes it, and
any other is born with a new identity.

Classes named in group_classes may be seen so close together that single identities mean nothing: what a track's gate, a volume's outline
or another candidate's neighbourhood holds is one group with a size, and a member that turns up away from it is born as split from it. A track that loses its
views inside a hand's boxes, after it was within reach of that hand, is held: it moves as the hand moves until it is seen again or the hand is lost.

The same Tracker runs over a batch (one trial a group) and in a stream (state kept between micro-batches).
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from sightline.operators.geometry import project, residuals, triangulate
from sightline.operators.matching import greedy
from sightline.streaming import ordered

COLUMNS = (
    "frame long, track_id string, object_class string, x double, y double, z double, uncertainty double, views int, state string, confidence double, possibly_same_as string, "
    "group_size int, container string, split_from string, held_by string"
)


@dataclass(frozen=True)
class Settings:
    gate_px: float = 30.0
    base_uncertainty: float = 1.0
    most_uncertainty: float = 30.0
    noise: float = 2.0
    coast_growth: float = 1.0
    timeout: int = 30
    birth_views: int = 2
    resume_views: int = 2
    abstain_below: float = 0.3
    group_classes: tuple[str, ...] = ()
    group_radius: float = 2.5
    split_radius: float = 30.0
    hand_classes: tuple[str, ...] = ()
    held_views: int = 2
    reach: float = 10.0


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of points in a plane, in turning order, from the first by x, then y."""
    p = np.unique(np.asarray(points, float), axis=0)

    def chain(order) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for x in order:
            while len(out) > 1 and np.linalg.det([out[-1] - out[-2], x - out[-1]]) <= 0:
                out.pop()
            out.append(x)
        return out

    return p if len(p) < 3 else np.array(chain(p)[:-1] + chain(p[::-1])[:-1])


@dataclass(frozen=True)
class Volume:
    """A container: a box in space from low to high."""

    name: str
    low: tuple[float, float, float]
    high: tuple[float, float, float]

    def outline(self, camera: np.ndarray) -> np.ndarray | None:
        """The hull of its corners as a view sees it; none if a corner lies behind the camera."""
        corners = np.array(list(itertools.product(*zip(self.low, self.high))))
        if (corners @ camera[2, :3] + camera[2, 3] <= 0).any():
            return None
        return hull(np.array([project(camera, c) for c in corners]))

    def above(self, place: np.ndarray) -> bool:
        return all(self.low[i] <= place[i] <= self.high[i] for i in (0, 1))


def within(outline: np.ndarray, point) -> bool:
    edge = np.roll(outline, -1, axis=0) - outline
    to = np.asarray(point, float) - outline
    return bool((edge[:, 0] * to[:, 1] - edge[:, 1] * to[:, 0] >= -1e-9).all())


@dataclass
class Track:
    name: str
    object_class: str
    place: np.ndarray
    uncertainty: float
    seen: int
    views: int = 0
    state: str = "observed"
    residual: float = 0.0
    same_as: str | None = None
    size: int | None = None
    container: str | None = None
    split_from: str | None = None
    held_by: str | None = None
    reached: dict[str, np.ndarray] = field(default_factory=dict)

    @property
    def localised(self) -> bool:
        return self.state in ("observed", "single_view")


@dataclass
class Tracker:
    cameras: dict[str, np.ndarray]
    settings: Settings = field(default_factory=Settings)
    volumes: tuple[Volume, ...] = ()
    live: list[Track] = field(default_factory=list)
    frame: int | None = None
    born: int = 0

    def _gate(self, track: Track, camera: np.ndarray) -> float:
        depth = max(abs(float(camera[2] @ np.append(track.place, 1.0))), 1e-6)
        return self.settings.gate_px + track.uncertainty * float(np.linalg.norm(camera[0, :3])) / depth

    def _associate(self, rows: list[tuple]) -> dict[int, dict[str, int]]:
        found: dict[int, dict[str, int]] = {}
        for view in sorted({r[0] for r in rows}):
            camera = self.cameras[view]
            index = [i for i, r in enumerate(rows) if r[0] == view]
            cost = np.full((len(self.live), len(index)), np.inf)
            for t, track in enumerate(self.live):
                at, gate = project(camera, track.place), self._gate(track, camera)
                for k, i in enumerate(index):
                    d = math.dist(at, rows[i][2:4])
                    if rows[i][1] == track.object_class and d <= gate and track.container is None:
                        cost[t, k] = d
            for t, k in greedy(cost, np.finfo(float).max):
                found.setdefault(t, {})[view] = index[k]
        return found

    def _update(self, track: Track, mine: dict[str, int], rows: list[tuple], dt: int) -> None:
        s = self.settings
        track.views = len(mine)
        if not mine:
            self._hold(track, rows)
            track.state = "coasting" if track.held_by is None else "held"
            track.uncertainty = min(s.most_uncertainty, track.uncertainty + s.coast_growth * dt)
            return
        track.seen, track.held_by = self.frame, None
        if len(mine) == 1:
            track.state = "single_view"
            return
        cameras = np.stack([self.cameras[v] for v in mine])
        points = np.array([rows[i][2:4] for i in mine.values()], float)
        found = triangulate(cameras, points)
        worst = residuals(cameras, points, found)
        track.residual = float(np.median(worst))
        measured = max(s.base_uncertainty, track.residual / s.gate_px * s.base_uncertainty)
        gain = track.uncertainty**2 / (track.uncertainty**2 + measured**2)
        track.place = track.place + gain * (found - track.place)
        track.uncertainty = math.sqrt((1 - gain) * track.uncertainty**2)
        track.state = "observed"

    # ---- holds

    def _hold(self, track: Track, rows: list[tuple]) -> None:
        """A track without views begins to be held if enough views have its place inside a box of one hand class and it had that hand within reach when it was last seen; a held one moves on with its hand or is let go."""
        s = self.settings
        if track.object_class in s.hand_classes or track.container is not None:
            return
        hands = {h.name: h for h in self.live if h.object_class in s.hand_classes and h.seen == self.frame}
        if track.held_by is None and track.localised:  # its views were lost in this frame
            views: dict[str, set[str]] = {}
            for view, kind, u, v, w, h in rows:
                if kind in s.hand_classes and w > 0 and h > 0:
                    x, y = project(self.cameras[view], track.place)
                    if abs(x - u) <= w / 2 and abs(y - v) <= h / 2:
                        views.setdefault(kind, set()).add(view)
            kind = max(views, key=lambda k: (len(views[k]), k), default=None)
            if kind is None or len(views[kind]) < s.held_views:
                return
            near = [n for n in track.reached if n in hands and hands[n].object_class == kind]
            track.held_by = min(near, key=lambda n: (float(np.linalg.norm(track.reached[n])), n), default=None)
        if track.held_by is not None:
            if track.held_by in hands:
                track.place = hands[track.held_by].place + track.reached[track.held_by]
            else:
                track.held_by = None

    def _reach(self) -> None:
        """Where each localised track lies from every hand within reach."""
        hands = [h for h in self.live if h.object_class in self.settings.hand_classes and h.localised]
        for t in self.live:
            if hands and t.localised and t.object_class not in self.settings.hand_classes:
                t.reached = {h.name: t.place - h.place for h in hands if np.linalg.norm(t.place - h.place) <= self.settings.reach}

    # ---- groups

    def _footprints(self, rows: list[tuple], taken: set[int]) -> None:
        """One group for each volume and class: what is seen inside the volume's outline and belongs to no single track."""
        s = self.settings
        for volume in self.volumes:
            outlines = {v: volume.outline(c) for v, c in self.cameras.items()}
            for kind in s.group_classes:
                inside: dict[str, list[int]] = {}
                for i, r in enumerate(rows):
                    if r[1] == kind and i not in taken and outlines[r[0]] is not None and within(outlines[r[0]], r[2:4]):
                        inside.setdefault(r[0], []).append(i)
                group = next((t for t in self.live if t.container == volume.name and t.object_class == kind), None)
                size = round(float(np.median([len(x) for x in inside.values()]))) if inside else 0
                if group is None:
                    if len(inside) < max(2, s.birth_views) or size < 2:
                        continue
                    group = self._bear(kind, self._middle(rows, inside), len(inside))
                    group.container = volume.name
                elif len(inside) >= 2:
                    group.place, group.uncertainty, group.state = self._middle(rows, inside), s.base_uncertainty, "observed"
                elif inside:
                    group.state = "single_view"
                group.views = len(inside)
                if inside:
                    group.size, group.seen = size, self.frame
                    taken.update(i for x in inside.values() for i in x)
                else:
                    group.state = "coasting"

    def _middle(self, rows: list[tuple], inside: dict[str, list[int]]) -> np.ndarray:
        return triangulate(np.stack([self.cameras[v] for v in inside]), np.array([np.mean([rows[i][2:4] for i in x], axis=0) for x in inside.values()]))

    def _absorb(self, rows: list[tuple], mine: dict[int, dict[str, int]], taken: set[int]) -> None:
        """A seen track of a group class takes what else its views show in its gate; its size is one more than the middle count."""
        for k, t in enumerate(self.live):
            if t.object_class not in self.settings.group_classes or not t.localised or t.container is not None:
                continue
            counts = []
            for view in mine.get(k, {}):
                at, gate = project(self.cameras[view], t.place), self._gate(t, self.cameras[view])
                near = [i for i, r in enumerate(rows) if i not in taken and r[0] == view and r[1] == t.object_class and math.dist(at, r[2:4]) <= gate]
                taken.update(near)
                counts.append(len(near))
            more = round(float(np.median(counts))) if counts else 0
            t.size = 1 + more if more else None

    def _merged(self, fresh: list[tuple]) -> list[tuple]:
        """Candidates of a group class within the radius of the first of them are one with a size; near a seen track of the class they only make it larger."""
        s, out, used = self.settings, [], set()
        for i, (kind, found, members, _) in enumerate(fresh):
            if i in used:
                continue
            if kind not in s.group_classes:
                out.append((kind, found, members, None))
                continue
            near = next((t for t in self.live if t.object_class == kind and t.localised and np.linalg.norm(t.place - found) <= s.group_radius), None)
            if near is not None:
                near.size = (near.size or 1) + 1
                continue
            same = [j for j in range(i, len(fresh)) if j not in used and fresh[j][0] == kind and np.linalg.norm(fresh[j][1] - found) <= s.group_radius]
            used.update(same)
            out.append((kind, np.mean([fresh[j][1] for j in same], axis=0) if len(same) > 1 else found, members, len(same) if len(same) > 1 else None))
        return out

    def _source(self, kind: str, found: np.ndarray) -> str | None:
        """The nearest group that a candidate outside all volumes may have left."""
        s = self.settings
        if kind not in s.group_classes or any(v.above(found) for v in self.volumes):
            return None
        near = [(float(np.linalg.norm(t.place - found)), t.name) for t in self.live if t.object_class == kind and (t.size or 0) >= 2]
        return next((name for d, name in sorted(near) if d <= s.split_radius), None)

    def _bear(self, kind: str, place: np.ndarray, views: int) -> Track:
        self.born += 1
        self.live.append(Track(f"{kind}-{self.born}", kind, place, self.settings.base_uncertainty, self.frame, views))
        return self.live[-1]

    # ---- births

    def _candidates(self, rows: list[tuple], free: list[int]) -> list[tuple[str, np.ndarray, list[int]]]:
        """Greedy cliques of views that agree, cheapest pair first."""
        pairs = []
        for i, j in itertools.combinations(free, 2):
            if rows[i][1] == rows[j][1] and rows[i][0] != rows[j][0]:
                cameras = np.stack([self.cameras[rows[k][0]] for k in (i, j)])
                points = np.array([rows[k][2:4] for k in (i, j)], float)
                found = triangulate(cameras, points)
                worst = float(residuals(cameras, points, found).max())
                if worst <= self.settings.gate_px:
                    pairs.append((worst, i, j, found))
        used: set[int] = set()
        out = []
        for _, i, j, found in sorted(pairs, key=lambda p: p[:3]):
            if used & {i, j}:
                continue
            members = [i, j]
            for k in free:
                if k not in used and k not in members and rows[k][1] == rows[i][1] and rows[k][0] not in {rows[m][0] for m in members}:
                    if math.dist(project(self.cameras[rows[k][0]], found), rows[k][2:4]) <= self.settings.gate_px:
                        members.append(k)
                        found = triangulate(np.stack([self.cameras[rows[m][0]] for m in members]), np.array([rows[m][2:4] for m in members], float))
            if len(members) >= self.settings.birth_views:
                used |= set(members)
                out.append((rows[i][1], found, members))
        return out

    def _resume_or_bear(self, rows: list[tuple], free: list[int]) -> None:
        waiting = [t for t in self.live if t.views == 0 and t.container is None]
        fresh = self._merged([(*x, None) for x in self._candidates(rows, free)])
        fits: dict[int, list[Track]] = {}
        for c, (kind, _, members, _) in enumerate(fresh):
            for t in waiting:
                hits = sum(math.dist(project(self.cameras[rows[m][0]], t.place), rows[m][2:4]) <= self._gate(t, self.cameras[rows[m][0]]) for m in members)
                if t.object_class == kind and hits >= self.settings.resume_views:
                    fits.setdefault(c, []).append(t)
        wanted = {id(t): sum(any(x is t for x in ts) for ts in fits.values()) for ts in fits.values() for t in ts}
        for c, (kind, found, members, size) in enumerate(fresh):
            mine = fits.get(c, [])
            if len(mine) == 1 and wanted[id(mine[0])] == 1:
                t = mine[0]
                t.place, t.uncertainty, t.seen, t.views, t.state = found, self.settings.base_uncertainty, self.frame, len(members), "observed"
                t.held_by, t.size = None, size
                continue
            source = self._source(kind, found)
            t = self._bear(kind, found, len(members))
            t.same_as, t.size, t.split_from = min((x.name for x in mine), default=None), size, source

    def step(self, frame: int, observations: list[tuple]) -> list[tuple]:
        """The rows of live tracks, and of those lost in this frame. observations: (view, object_class, u, v), if known with their boxes' width and height; unknown views are passed over."""
        dt = 1 if self.frame is None else max(1, frame - self.frame)
        self.frame = frame
        rows = sorted((*r, 0.0, 0.0)[:6] for r in observations if r[0] in self.cameras)
        for t in self.live:
            t.uncertainty = min(self.settings.most_uncertainty, math.hypot(t.uncertainty, self.settings.noise * dt))
        found = self._associate(rows)
        order = sorted(range(len(self.live)), key=lambda k: k not in found)  # hands that are seen move before what they hold
        for k in order:
            if self.live[k].container is None:
                self._update(self.live[k], found.get(k, {}), rows, dt)
        taken = {i for mine in found.values() for i in mine.values()}
        self._footprints(rows, taken)
        self._absorb(rows, found, taken)
        self._reach()
        self._resume_or_bear(rows, [i for i in range(len(rows)) if i not in taken])
        for t in self.live:
            if frame - t.seen > self.settings.timeout:
                t.state = "lost"
        out = [self._row(t) for t in self.live]
        self.live = [t for t in self.live if t.state != "lost"]
        return out

    def _row(self, t: Track) -> tuple:
        confidence = 0.0
        if t.state == "observed":
            confidence = t.views / max(2, len(self.cameras)) * min(max(1 - t.residual / self.settings.gate_px, 0.0), 1.0)
        return (self.frame, t.name, t.object_class, *map(float, t.place), float(t.uncertainty), t.views, t.state, float(confidence), t.same_as, t.size, t.container, t.split_from, t.held_by)


def _names() -> list[str]:
    return [c.split()[0] for c in COLUMNS.split(", ")]


_SEEN = ["frame", "view", "object_class", "u", "v"]
_BOX = ["width", "height"]


def _observations(df: DataFrame) -> list[str]:
    """The columns of observations that df has: with boxes only if it has both their sizes."""
    return [*_SEEN, *(_BOX if set(_BOX) <= set(df.columns) else [])]


def _frames(rows: pd.DataFrame):
    columns = [c for c in rows.columns if c != "frame"]
    for frame, part in rows.sort_values(["frame", *columns]).groupby("frame"):
        yield int(frame), [tuple(0.0 if x is None or x != x else x for x in r) for r in part[columns].itertuples(index=False, name=None)]


def _typed(rows: list[tuple], trial: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[trial, *_names()])
    return out.astype({"group_size": "Int32"})


def track(df: DataFrame, trial: str, cameras: dict[str, list], settings: Settings | None = None, volumes: tuple[Volume, ...] = ()) -> DataFrame:
    """Track rows of each trial. df has trial, frame, view, object_class, u, v, and may have width and height of boxes; cameras hold 3x4 matrices by view."""
    kind = df.schema[trial].dataType.simpleString()
    rig = {v: np.array(c, float) for v, c in cameras.items()}
    seen = _observations(df)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        tracker = Tracker(rig, settings or Settings(), volumes)
        return _typed([(rows[trial].iloc[0], *r) for frame, observations in _frames(rows[seen]) for r in tracker.step(frame, observations)], trial)

    return df.select(trial, *seen).groupBy(trial).applyInPandas(one, f"{trial} {kind}, {COLUMNS}")


def track_stream(df: DataFrame, trial: str, cameras: dict[str, list], settings: Settings | None = None, late: int = 5, volumes: tuple[Volume, ...] = (), time: str | None = None, idle: str = "1 minute") -> DataFrame:
    """The same over a stream, frames in order and trials ended as streaming.ordered.fold says."""
    rig = {v: np.array(c, float) for v, c in cameras.items()}

    def step(tracker: Tracker, rows: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame([r for frame, observations in _frames(rows) for r in tracker.step(frame, observations)], columns=_names())
        return out.astype({"group_size": "Int32"})

    return ordered.fold(df, [trial], "frame", _observations(df), lambda: Tracker(rig, settings or Settings(), volumes), step, COLUMNS, late, time, idle)
