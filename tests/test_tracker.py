"""Groups, holds and closing timers of the tracker."""

import json

import numpy as np

from sightline.operators import tracker
from sightline.operators.geometry import project

LENS = np.array([[800.0, 0, 640], [0, 800.0, 360], [0, 0, 1]])


def looking(angle, tilt=0.5, far=80.0):
    c, s = np.cos(angle), np.sin(angle)
    turn = np.array([[1, 0, 0], [0, np.cos(tilt), -np.sin(tilt)], [0, np.sin(tilt), np.cos(tilt)]]) @ np.array([[c, 0, -s], [0, 1, 0], [s, 0, c]])
    return LENS @ np.hstack([turn, [[0], [0], [far]]])


CAMERAS = {f"v{k}": looking(a) for k, a in enumerate((-0.8, 0.0, 0.7, 1.5))}


def seen(place, kind, views=tuple(CAMERAS), size=(10.0, 10.0)):
    return [(v, kind, *project(CAMERAS[v], np.asarray(place, float)), *size) for v in views]


def run(frames, settings, volumes=()):
    """track name: {frame: row} over lists of observations by frame."""
    t = tracker.Tracker(CAMERAS, settings, volumes)
    names = tracker._names()
    out = {}
    for frame, observations in enumerate(frames):
        for r in t.step(frame, observations):
            row = dict(zip(names, r))
            out.setdefault(row["track_id"], {})[frame] = row
    return out


RACK = tracker.Volume("rack", (-6.0, -1.0, -6.0), (6.0, 1.0, 6.0))


def rack_frames(tubes=4, leaves=15, back=20, total=40):
    places = [np.array([1.5 * k - 2, 0.0, 0.0]) for k in range(tubes)]
    far = places[-1] + [0.0, 14.0, 0.0]
    frames = []
    for f in range(total):
        here = places if f < leaves else places[:-1] + ([far] if f >= back else [])
        frames.append([x for p in here for x in seen(p, "tube")])
    return frames, far


def test_a_group_in_a_container_and_a_member_that_leaves_it():
    frames, far = rack_frames()
    plain = run(frames, tracker.Settings(gate_px=8.0))
    assert len(plain) >= 4
    found = run(frames, tracker.Settings(gate_px=8.0, group_classes=("tube",)), (RACK,))
    assert len(found) == 2
    group, member = (found[k] for k in sorted(found))
    assert all(group[f]["container"] == "rack" and group[f]["state"] == "observed" for f in range(40))
    assert [group[f]["group_size"] for f in (0, 14, 15, 39)] == [4, 4, 3, 3]
    assert min(member) == 20 and member[20]["split_from"] == group[0]["track_id"] == member[39]["split_from"]
    assert np.linalg.norm(np.array([member[39][c] for c in "xyz"]) - far) < 0.01 and member[39]["container"] is None


def test_near_candidates_are_one_group_without_a_container():
    frames = [[x for k in range(2) for x in seen([1.5 * k, 0, 0], "tube")]] * 10
    one = run(frames, tracker.Settings(gate_px=25.0, group_classes=("tube",)))
    (track,) = one.values()
    assert {track[f]["group_size"] for f in track} == {2} and all(track[f]["container"] is None for f in track)
    assert len(run(frames, tracker.Settings(gate_px=4.0, group_classes=("tube",)))) == 1  # merged as candidates, absorbed or counted afterwards
    assert len(run(frames, tracker.Settings(gate_px=4.0, group_classes=("pen",)))) == 2


def hand_frames(offset, hand=True, box=(300.0, 300.0), lost_hand=None, gone=(10, 20), total=26):
    frames = []
    for f in range(total):
        at = np.array([-12.0 + f, 0.5 * f - 6, 0.0])
        rows = seen(at, "hand", size=box) if hand and not (lost_hand is not None and f >= lost_hand) else []
        if not gone[0] <= f < gone[1]:
            rows = rows + seen(at + offset, "tube")
        frames.append(rows)
    return frames


HOLD = tracker.Settings(gate_px=20.0, hand_classes=("hand",), reach=5.0, timeout=15, noise=0.5, coast_growth=0.2)


def test_a_held_track_follows_its_hand_and_is_seen_again():
    offset = np.array([2.0, 0.0, -1.0])
    found = run(hand_frames(offset), HOLD)
    tube = next(v for k, v in found.items() if k.startswith("tube"))
    hand = next(k for k in found if k.startswith("hand"))
    assert len(found) == 2 and [tube[f]["state"] for f in (9, 10, 19, 20, 25)] == ["observed", "held", "held", "observed", "observed"]
    assert all(tube[f]["held_by"] == hand for f in range(10, 20)) and tube[20]["held_by"] is None
    for f in range(10, 20):
        truth = np.array([-12.0 + f, 0.5 * f - 6, 0.0]) + offset
        assert np.linalg.norm(np.array([tube[f][c] for c in "xyz"]) - truth) < 3.0  # what blending lags behind
    assert [tube[f]["uncertainty"] for f in (10, 14, 19)] == sorted(tube[f]["uncertainty"] for f in (10, 14, 19))


def test_a_hold_is_refused_and_released():
    states = lambda frames: {f: r["state"] for f, r in next(v for k, v in run(frames, HOLD).items() if k.startswith("tube")).items()}
    assert states(hand_frames(np.array([2.0, 0, -1.0]), hand=False))[12] == "coasting"
    assert states(hand_frames(np.array([7.0, 0, 0])))[12] == "coasting"  # inside the box, never within reach
    assert states(hand_frames(np.array([2.0, 0, -1.0]), box=(4.0, 4.0)))[12] == "coasting"  # no box holds it
    released = states(hand_frames(np.array([2.0, 0, -1.0]), lost_hand=14))
    assert released[13] == "held" and released[14] == "coasting"
    ended = states(hand_frames(np.array([2.0, 0, -1.0]), gone=(5, 99), total=30))
    assert ended[5] == "held" and ended[20] == "lost" and 21 not in ended


def test_outlines():
    points = np.random.default_rng(4).normal(size=(60, 2))
    corners = tracker.hull(points)
    assert all(tracker.within(corners, p) for p in points) and not tracker.within(corners, corners[0] * 1.01 - corners.mean(0) * 0.01)
    turns = np.roll(corners, -1, 0) - corners
    assert (turns[:, 0] * np.roll(turns, -1, 0)[:, 1] - turns[:, 1] * np.roll(turns, -1, 0)[:, 0] > 0).all()
    assert len(tracker.hull(np.array([[0.0, 0], [1, 1], [2, 2]]))) == 2 and len(tracker.hull(np.array([[0, 0], [0, 2], [2, 0], [2, 2], [1, 1], [1, 0]]))) == 4
    assert tracker.Volume("x", (-1, -1, -200), (1, 1, 200)).outline(CAMERAS["v1"]) is None


def rows_of(trial, frames, start="2024-01-01 00:00:00"):
    import datetime as dt

    t0 = dt.datetime.fromisoformat(start)
    return [{"trial": trial, "frame": f, "view": v, "object_class": k, "u": float(a), "v": float(b), "width": w, "height": h, "ts": str(t0 + dt.timedelta(seconds=f))} for f, x in enumerate(frames) for v, k, a, b, w, h in x]


def test_batch_is_stream_and_no_frame_is_lost(spark, tmp_path):
    settings = tracker.Settings(gate_px=8.0, group_classes=("tube",), hand_classes=("hand",), reach=5.0)
    frames = [a + b for a, b in zip(rack_frames(total=26)[0], ([x for x in f if x[1] == "hand"] for f in hand_frames(np.zeros(3))))]
    made = rows_of("a", frames) + rows_of("b", frames[:9])
    later = rows_of("c", frames[:1], "2024-01-01 03:00:00") + rows_of("d", frames[:1], "2024-01-01 06:00:00")
    schema = "trial string, frame long, view string, object_class string, u double, v double, width double, height double, ts timestamp"
    folder = tmp_path / "in"
    folder.mkdir()
    at = lambda r: r["trial"] == "a" and r["frame"] >= 13
    for name, part in (("1", [r for r in made if not at(r)]), ("2", [r for r in made if at(r)]), ("3", later[: len(later) // 2]), ("4", later[len(later) // 2 :])):
        (folder / f"{name}.json").write_text("\n".join(json.dumps(r) for r in part))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder)).withWatermark("ts", "10 seconds")
    out = tracker.track_stream(source, "trial", CAMERAS, settings, late=5, volumes=(RACK,), time="ts", idle="2 minutes")
    q = out.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    rounded = lambda df: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)
    batch = tracker.track(spark.createDataFrame(made, "trial string, frame long, view string, object_class string, u double, v double, width double, height double, ts string"), "trial", CAMERAS, settings, (RACK,))
    assert rounded(spark.table("closed").filter("trial in ('a', 'b')")) == rounded(batch) and batch.agg({"frame": "max"}).first()[0] == 25
