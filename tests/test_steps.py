"""Small tables with results worked out by hand, and streams against their batch twins."""

import tempfile

import pytest
from pyspark.sql import functions as F

from trackspark.functions import geometry as g
from trackspark.operators import tags, tracker, tracks
from trackspark.plans import models, streams
from trackspark.plans.streams import detections
from trackspark.sources.fixtures import read
from trackspark.streaming import cameras

DATA = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def short_track(spark):
    """Six regions: one blank, one at the border, one gap."""
    rows = [(1, 1, 0, 50, 50, 10, 10, 100, False, 4.0), (1, 1, 1, 53, 54, 10, 10, 120, False, 9.0), (1, 1, 2, 53, 54, 10, 10, 0, True, 0.0), (1, 1, 3, 0, 54, 10, 10, 80, False, 4.0), (1, 1, 5, 20, 54, 18, 10, 90, False, 4.0), (1, 1, 6, 24, 54, 10, 10, 1, False, 4.0)]
    return spark.createDataFrame(rows, "clip_id long, track_id long, frame_number long, x long, y long, width long, height long, mass long, blank boolean, pixel_variance double")


def test_track_statistics_by_hand(short_track):
    s = tracks.movement_statistics(short_track, g.fixed(1, 1, 158, 118)).first()
    # steps next to the blank do not count: 5, then 24, then nothing as only the width changed
    assert s.movement == pytest.approx(5 + 24)
    assert s.frames == 6 and s.frames_moved == 3
    assert s.blank_frames == 1 and s.blank_percent == 17 and s.jitter_bigger + s.jitter_smaller == 1
    assert s.average_mass == pytest.approx(391 / 5) and s.median_mass == 90 and s.delta_std == pytest.approx(5.0**0.5)


def test_track_windows_by_hand(short_track):
    assert rows_of(tracks.with_velocity(short_track), "frame_number", "vx", "vy")[:3] == [(0, 0.0, 0.0), (1, 3.0, 4.0), (2, 0.0, 0.0)]
    assert rows_of(tracks.with_visibility(short_track), "frame_number", "since_seen", "blanks", "clear_run") == [(0, 0, 0, 1), (1, 0, 0, 2), (2, 1, 1, 2), (3, 0, 1, 1), (5, 0, 1, 2), (6, 0, 1, 3)]
    filled = rows_of(tracks.fill_gaps(short_track).where("frame_number = 4"), "x", "mass", "blank")
    assert filled == [(0, 0, True)]
    trimmed = tracks.trim(short_track)
    assert rows_of(trimmed, "frame_number")[-1] == (5,) and rows_of(tracks.trim(trimmed), "frame_number") == rows_of(trimmed, "frame_number")


def region(i, x, y, w=8, h=8, mass=50, variance=9.0, border=False):
    return (i, x, y, w, h, mass, variance, border)


def test_gates_noise_blanks_and_prediction():
    state = tracker.fresh_state()
    step = lambda *rs: [r[:4] for r in tracker.track_step(state, list(rs))]
    assert step(region(1, 10, 10)) == [(1, 1, True, False)]
    assert step(region(2, 10, 10, 40, 40)) == [(None, 1, False, True), (2, 2, True, False)]  # 25 times the area: another one
    assert step(region(3, 10, 10, mass=2), region(4, 11, 10, 40, 40)) == [(4, 2, False, False), (None, 1, False, True)]  # noise blanks track 1, which has been unseen too long
    assert set(state["active"]) == {2}
    assert step(region(5, 90, 90, 40, 40)) == [(None, 2, False, True), (5, 3, True, False)]  # further than any reach
    state = tracker.fresh_state()
    for f in range(25):
        step(region(f, 5 + 4 * f, 50, mass=60))
    assert step(region(99, 105, 50, mass=200)) == [(None, 1, False, True)]  # the mass is watched after a second and a half; lies over the track
    boxes = [tracker.track_step(state, [])[0][4:8] for _ in range(2)]
    assert boxes[1][0] - boxes[0][0] == pytest.approx(4, abs=1) and boxes[0][0] > 105  # blanks go on as predicted
    assert step(region(100, 118, 50, mass=60)) == [(100, 1, False, False)]


def test_calibration_ends_tracks(spark):
    rows = [(1, f, 7, 20, 20, 8, 8, 50, 9.0, False, f == 5) for f in range(10)]
    v = spark.createDataFrame(rows, "clip_id long, frame_number long, region_id long, x long, y long, width long, height long, mass long, pixel_variance double, along_border boolean, calibrating boolean")
    assert rows_of(tracker.assign(v), "frame_number", "online_track") == [(f, 1) for f in range(5)] + [(f, 2) for f in range(6, 10)]


def test_crossing_boxes_are_matched_one_to_one():
    state = tracker.fresh_state()
    seen = [tracker.track_step(state, [region(10 + f, 10 + 5 * f, 10), region(20 + f, 60 - 5 * f, 12)]) for f in range(4)]
    assert [{(r[0] // 10, r[1]) for r in s} for s in seen] == [{(1, 1), (2, 2)}] * 4 and all(r[2] for r in seen[0])
    over = tracker.track_step(state, [region(14, 30, 10), region(99, 31, 10), region(24, 40, 12)])
    assert 99 not in {r[0] for r in over if r[2]}
    for _ in range(60):
        tracker.track_step(state, [])
    assert not state["active"]
    pairs = [(1.0, 0, "a", "x"), (1.0, 0, "b", "x"), (2.0, 0, "b", "y"), (0.5, 1, "c", "y")]
    assert tracker.greedy(pairs) == [("c", "y"), ("a", "x")]


def test_constant_velocity():
    m = tracker.Motion(0, 0)
    for i in range(1, 30):
        m.predict()
        m.correct(3.0 * i, -2.0 * i)
    x, y = m.predict()
    assert x == pytest.approx(90, abs=1) and y == pytest.approx(-60, abs=1)


def test_token_bucket_and_hysteresis():
    b = tracker.Bucket(tokens=3, fps=1, no_motion=5, max_throttle=20, free=2)
    trace = [(0, True), (1, True), (2, True), (3, True), (4, True), (6, False), (10, True), (11, True), (12, True), (13, True), (13.5, True)]
    assert [b.step(t, m) for t, m in trace] == [True, True, True, False, False, False, True, True, True, False, False]
    assert list(tracker.hysteresis(iter([True, True, False, False, False, True]), 30, 2)) == [False, True, True, False, False, False]


def test_best_tag(spark):
    rows = [(1, 1, "rat", "all.mammal.rodent.rat", False, 0.9), (1, 2, "rodent", "all.mammal.rodent", False, 0.9), (2, 3, "kiwi", "all.bird.kiwi", False, 0.8), (2, 4, "rat", "all.mammal.rodent.rat", False, 0.8), (3, 5, "rat", "all.mammal.rodent.rat", True, 0.9), (4, 6, "bird", "all.bird", False, 0.2), (5, 7, "bird", "all.bird", False, 0.7), (5, 8, "kiwi", "all.bird.kiwi", False, 0.6)]
    t = spark.createDataFrame(rows, "track_id long, tag_id long, what string, path string, automatic boolean, confidence double")
    assert {r.track_id: r.what for r in tags.best_human_tag(t, min_confidence=0.5).collect()} == {1: "rat", 2: None, 5: "bird"}


def stream_of(spark, df, parts, *order):
    """A file stream of a table in several files, in order; rows with equal keys stay together."""
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = df.orderBy(*order).collect()
    key = lambda i: [rows[i][c] for c in order] if i else None
    cuts = [0]
    for i in range(1, parts):
        at = i * len(rows) // parts
        while at < len(rows) and key(at) == key(at - 1):
            at += 1
        cuts.append(at)
    for a, b in zip(cuts, [*cuts[1:], len(rows)], strict=True):
        spark.createDataFrame(rows[a:b], df.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_stream_sessions_equal_batch(spark):
    frames = read(spark, DATA, "v_stream").where("motion")
    batch = rows_of(cameras.gap_sessions(frames, 600), "camera", "first", "frames")
    got = rows_of(run(spark, cameras.gap_sessions(stream_of(spark, frames, 3, "ts"), 600, "1 hour"), "sessions"), "camera", "first", "frames")
    assert got and set(got) <= set(batch) and len(got) >= len(batch) - 12  # those still open at the end are not given


def test_stream_throttle_and_tracker_equal_batch(spark):
    frames = read(spark, DATA, "v_stream")
    got = rows_of(run(spark, cameras.throttled(stream_of(spark, frames, 3, "ts")), "throttled", "append"), "event_id", "flag")
    assert got == rows_of(tracker.per_camera(frames, "throttle"), "event_id", "flag")
    regions = detections(read(spark, DATA, "v_regions").where("clip_id < 3"))
    columns = ("clip_id", "frame_number", "online_track", "created", "blank", "x", "y", "mass")
    got = rows_of(run(spark, cameras.online_tracks(stream_of(spark, regions, 2, "frame_number")), "tracked", "append"), *columns)
    assert got == rows_of(tracker.assign(regions), *columns)


@pytest.mark.parametrize("kind", ["ring", "detector", "cadence", "ir", "simple"])
def test_stream_steps_equal_batch(spark, kind):
    """Steps over a stream in parts, over the whole table, and as window queries where there are some."""
    frames = read(spark, DATA, "v_stream")
    columns = tuple(c.split()[0] for c in tracker.gives(kind).split(", "))
    order = lambda rows: sorted(rows, key=repr)
    whole = order(tuple(r[c] for c in columns) for r in tracker.per_camera(frames, kind).collect())
    got = order(tuple(r[c] for c in columns) for r in run(spark, cameras.stepped(stream_of(spark, frames, 3, "ts"), kind), f"step_{kind}").collect())
    assert got == whole and whole
    twin = {"ring": streams.t01, "detector": streams.t02, "cadence": models.t10}.get(kind)
    if twin:
        assert order(tuple(r[c] for c in columns) for r in twin(frames).collect()) == whole


def test_stream_segments_and_recordings_equal_batch(spark):
    frames = read(spark, DATA, "v_stream")
    got = rows_of(run(spark, cameras.segments(stream_of(spark, frames, 3, "ts"), "1 hour", "1 hour"), "segments"), "camera", "start", "frames")
    batch = rows_of(streams.t14(frames), "camera", "start", "frames")
    assert got and set(got) <= set(batch) and len(got) >= len(batch) - 40  # those still open at the end are not given
    at = lambda rows: spark.createDataFrame(rows, "stem string, t int").select("stem", F.timestamp_seconds(F.col("t") + 1_700_000_000).alias("ts"))
    media, sides = at([("a", 0), ("b", 60), ("c", 120)]), at([("b", 90), ("a", 300), ("d", 400), ("c", 9000)])
    found = run(spark, cameras.recordings(stream_of(spark, media, 2, "ts"), stream_of(spark, sides, 2, "ts")), "recordings")
    assert sorted(r.stem for r in found.collect()) == ["a", "b"]  # the sidecar of c comes hours later
