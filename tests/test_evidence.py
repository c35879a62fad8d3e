"""Signed evidence against a plain loop, in batch and stream."""

import datetime as dt
import json
import random

from sightline.operators import evidence

RULES = evidence.Rules(keep=0.9, settle=1.5, turn=2.5, gap=6)


def loop(rows):
    """(key, frame): values, by the definition."""
    out = {}
    for key in {k for k, _, _ in rows}:
        frames = sorted({f for k, f, _ in rows if k == key})
        lo, sign, episode, own, before = 0.0, 0, 0, 0.0, None
        for f in frames:
            c = sum(v for k, g, v in rows if k == key and g == f)
            passed = 1 if before is None else f - before
            if before is not None and passed > 6:
                episode, own = episode + 1, 0.0
            lo = lo * 0.9**passed + c
            if sign == 0:
                sign = (lo > 1.5) - (lo < -1.5)
            elif sign * lo < -2.5:
                sign = -sign
            own += c
            before = f
            out[key, f] = (round(lo, 9), sign, episode, round(own, 9))
    return out


def made(n=45):
    r = random.Random(3)
    return [(k, f, r.choice([-1.0, -0.5, 0.25, 1.0, 1.5])) for k in ("a", "b", "c") for f in r.sample(range(130), n) for _ in range(r.randrange(1, 3))]


def told(df):
    return {(x.k, x.frame): (round(x.log_odds, 9), x.sign, x.episode, round(x.in_episode, 9)) for x in df.collect()}


def test_batch(spark):
    rows = made()
    df = spark.createDataFrame([*rows, ("a", None, 1.0), ("a", 5, None), (None, 3, 2.0)], "k string, frame long, c double")
    want = {**loop(rows), (None, 3): (2.0, 1, 0, 2.0)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")  # keys that go on in the next batch
    try:
        x = evidence.accumulated(df, ["k"], "frame", "c", RULES)
        assert told(x) == want
        parts = {(e.k, e.episode): e for e in evidence.episodes(x, ["k"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(parts) > 4 and {s for _, s, _, _ in want.values()} == {-1, 0, 1}
    for (k, n), e in parts.items():
        own = [(f, v) for (j, f), v in sorted(want.items(), key=lambda x: x[0][1]) if j == k and v[2] == n]
        peak = max(own, key=lambda x: (abs(x[1][3]), -x[0]))[1][3]
        assert (e.first, e.last, e.frames) == (own[0][0], own[-1][0], len(own)) and e.peak_sign == (peak > 0) - (peak < 0)
    assert evidence.accumulated(df.limit(0), ["k"], "frame", "c").count() == 0


def test_stream_is_batch_and_no_frame_is_lost(spark, tmp_path):
    rows, t0 = made(), dt.datetime(2024, 1, 1)
    late = sorted(rows, key=lambda x: x[1] + 3 * (x[2] > 0))
    folder = tmp_path / "in"
    folder.mkdir()
    later = [[("z", 0, 1.0, 3)], [("y", 0, 1.0, 6)], [("x", 0, 1.0, 9)]]
    parts = [[(*x, 0) for x in late[i * len(late) // 4 : (i + 1) * len(late) // 4]] for i in range(4)] + later
    for i, part in enumerate(parts):
        (folder / f"{i}.json").write_text("\n".join(json.dumps({"k": k, "frame": f, "c": c, "ts": str(t0 + dt.timedelta(hours=h, seconds=f))}) for k, f, c, h in part))
    source = spark.readStream.schema("k string, frame long, c double, ts timestamp").option("maxFilesPerTrigger", 1).json(str(folder)).withWatermark("ts", "10 seconds")
    out = evidence.accumulated_stream(source, ["k"], "frame", "c", RULES, late=4, time="ts", idle="5 minutes")
    q = out.writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert told(spark.table("told").filter("k < 'x'")) == loop(rows)
