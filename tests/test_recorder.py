"""Recorders, backgrounds and late rows: by hand, as folds of tables, and as streams."""

import datetime
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.operators import recorder as rec
from trackspark.streaming import cameras, processors

from .test_steps import rows_of, run

SETTINGS = rec.Recording(fps=1, preview_secs=2, min_secs=3, max_secs=8, idle_secs=30)
FRAMES = "camera long, ts timestamp, event_id long, motion boolean, ffc boolean"
START = datetime.datetime(2024, 1, 1)

#: Camera 1, a frame a second: motion at 3, extension at 5, quiet end; calibration holds a start back; long motion until full.
MOTION = {3, 5, 14, 15} | set(range(20, 31))
FFC = {14}


def table(spark, rows):
    return spark.createDataFrame([(c, START + datetime.timedelta(seconds=t), e, m, f) for c, t, e, m, f in rows], FRAMES)


def frames():
    rows = [(1, k, k, k in MOTION, k in FFC) for k in range(40)]
    rows += [(2, k, 100 + k, k >= 2, False) for k in range(4)]  # stops in a recording of two frames
    rows += [(2, 200 + k, 110 + k, k == 0, False) for k in range(3)]  # comes again; is gone again
    rows += [(3, k, 200 + k, k % 2 == 0, False) for k in range(7)]  # seven frames of motion now and then, then nothing
    return rows


BY_HAND = {
    (1, 3, 8, 6, (1, 2), "quiet", True),  # motion at 5, the third frame, moves the end to the sixth
    (1, 15, 18, 4, (13, 14), "quiet", True),  # 14 calibrates
    (1, 20, 27, 8, (18, 19), "full", True),
    (1, 28, 33, 6, (26, 27), "quiet", True),  # still in motion: starts again at once
    (2, 102, 103, 2, (100, 101), "idle", False),
    (2, 110, 112, 3, (), "idle", False),  # frames before the gap are no pre-roll
    (3, 200, 206, 7, (), "idle", True),  # more than pre-roll and minimum
}


def found(rows):
    return {(r.camera, r.start_event, r.end_event, r.frames, tuple(r.preview), r.reason, r.kept) for r in rows}


def test_recorder_by_hand(spark):
    rows = rec.recordings(table(spark, frames()), SETTINGS).collect()
    assert len(rows) == len(BY_HAND) and found(rows) == BY_HAND
    assert rec.recordings(table(spark, []), SETTINGS).count() == 0


def stream(spark, df, cuts, order="ts"):
    """A stream whose micro-batches are the rows up to each moment."""
    folder = tempfile.mkdtemp(prefix="spark-")
    edges = [None, *cuts, None]
    for a, b in zip(edges, edges[1:], strict=False):
        part = df
        part = part if a is None else part.where(F.col(order) >= F.lit(a))
        part = part if b is None else part.where(F.col(order) < F.lit(b))
        part.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


@pytest.mark.parametrize("cuts", [(4, 5, 16, 25, 150), (10, 205)])
def test_stream_recorder_equals_the_hand_made_trace(spark, cuts):
    """A camera that is silent is closed by its timer, when others have brought event time on."""
    later = frames() + [(9, 1000 + 100 * k, 900 + k, False, False) for k in range(3)]
    out = run(spark, processors.recordings(stream(spark, table(spark, later), [at(c) for c in (*cuts, 1000, 1100)]), SETTINGS), f"recorder_{len(cuts)}")
    rows = out.collect()
    assert found(rows) == BY_HAND and len(rows) == len(BY_HAND)


def pictures(spark):
    rng = np.random.default_rng(5)
    rows = [(c, at(k), k, [float(v) for v in 100 + 20 * c + rng.integers(-3, 4, 30) + (k > 6) * 2]) for c in range(2) for k in range(12)]
    return spark.createDataFrame(rows, "camera long, ts timestamp, frame_number long, pixels array<double>"), rows


def plain_background(rows, width, edge, step):
    """Pixel by pixel."""
    out = {}
    for c in {r[0] for r in rows}:
        bg, w = {}, {}
        for _, _, number, pixels in (r for r in rows if r[0] == c):
            height = len(pixels) // width
            for y in range(edge, height - edge):
                for x in range(edge, width - edge):
                    v = pixels[y * width + x]
                    if (y, x) not in bg or bg[y, x] >= v - w[y, x]:
                        bg[y, x], w[y, x] = v, 0 if (y, x) in bg else 0.0
                    else:
                        w[y, x] += step
            near = lambda k, n: min(max(k, edge), n - edge - 1)
            out[c, number] = [bg[near(y, height), near(x, width)] for y in range(height) for x in range(width)]
    return out


def test_background_by_pixel_and_as_a_stream(spark):
    df, rows = pictures(spark)
    want = plain_background(rows, 6, 1, 0.5)
    got = {(r.camera, r.frame_number): r.background for r in rec.backgrounds(df, 6, 1, 0.5).collect()}
    assert got == want
    last = {r.camera: (r.frame_number, r.background) for r in rec.backgrounds(df, 6, 1, 0.5, last_only=True).collect()}
    assert last == {c: (11, want[c, 11]) for c in (0, 1)}
    out = run(spark, processors.backgrounds(stream(spark, df, [at(3), at(4), at(9)]), 6, 1, 0.5), "backgrounds").collect()
    assert {(r.camera, r.frame_number): r.background for r in out} == want and len(out) == len(want)
    assert {(r.camera, r.frame_number, r.average, r.changed) for r in out} == {(r.camera, r.frame_number, r.average, r.changed) for r in rec.backgrounds(df, 6, 1, 0.5).collect()}


def test_background_rises_only_when_the_weight_makes_up_for_it():
    b = rec.Background(3, 1, 1.0)
    trace = [(b.frame([v] * 9), b.values[4]) for v in (10, 12, 12, 12, 9, 9)]
    assert trace == [(True, 10), (False, 10), (False, 10), (True, 12), (True, 9), (False, 9)]


def test_late_rows_are_counted_and_change_nothing(spark):
    """Two batches in order, then rows of hours ago: they come out at the side; the steps' answers stay the same."""
    good = [(k % 2, 60 * k, k, k % 3 == 0, False) for k in range(300)]
    late = [(0, 60 * k + 1, 1000 + k, True, False) for k in range(40)] + [(1, 3, 2000, True, False)]
    folder, clean = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    for rows in (good[:250], [*late, *good[250:270]], good[270:]):
        table(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        table(spark, [r for r in rows if r in good]).coalesce(1).write.mode("append").parquet(clean)
    read = lambda path: spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(path)
    out, place = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    for _ in range(2):  # started again, it writes none twice
        processors.count_late(read(folder), out, place, 3600).awaitTermination(120)
    assert {r.camera: r["count"] for r in spark.read.parquet(out).groupBy("camera").count().collect()} == {0: 40, 1: 1}
    flags = run(spark, processors.flagged(read(folder), 3600), "flags")
    assert flags.count() == 341 and {r.camera: r.n for r in flags.groupBy("camera").agg(F.max("late_rows").alias("n")).collect()} == {0: 40, 1: 1}
    with_late = rows_of(run(spark, cameras.stepped(read(folder), "throttle"), "with_late").where("event_id < 1000"), "event_id", "flag")
    assert with_late == rows_of(run(spark, cameras.stepped(read(clean), "throttle"), "without_late"), "event_id", "flag") and len(with_late) == 300
