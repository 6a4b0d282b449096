"""Clips are tracked to their last frame."""

from trackspark.plans import models, streams


def test_tracks_reach_the_last_frame(spark):
    rows = [(1, 7, f, 20, 20, 8, 8, 50, 9.0, False, False) for f in range(60)] + [(1, 8, f, 90, 90, 8, 8, 50, 9.0, False, False) for f in range(45, 60)]
    v = spark.createDataFrame(rows, "clip_id long, track_id long, frame_number long, x long, y long, width long, height long, mass long, pixel_variance double, blank boolean, ffc boolean")
    assert streams.j08(v).count() == 75
    assert sorted(tuple(r) for r in streams.t08(v).collect()) == [(1, 1, 0, 59, 60, 0), (1, 2, 45, 59, 15, 0)]
    assert {r.frame_number for r in models.t11(v).collect()} >= {45, 59}
