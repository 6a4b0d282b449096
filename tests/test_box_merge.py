"""Boxes of a frame are united; frames go through Python many at a time."""

import pandas as pd

from trackspark.operators import tracker

BOX = "clip_id long, frame_number long, x long, y long, width long, height long, mass long"


def test_frames_are_united_as_one_by_one(spark):
    """Frames of 1 to 9 boxes that cross batches; some meet only after others were united."""
    rows = [(c, f, (i * 37 + f * 11) % 140, (i * 53 + c * 7) % 100, 1 + i * 7 % 20, 1 + i * 11 % 20, i) for c in range(4) for f in range(25) for i in range(1 + (c + f) % 9)]
    want = []
    for _, part in pd.DataFrame(rows, columns=[c.split()[0] for c in BOX.split(", ")]).groupby(["clip_id", "frame_number"]):
        want += tracker.merge_boxes(part, 10.0).itertuples(index=False, name=None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = tracker.merge_components(spark.createDataFrame(rows[::-1], BOX), 10.0)
        got = sorted(tuple(r) for r in df.collect())
        assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString(), "a call for each frame"
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(want) and len(got) < len(rows)


def test_unknown_values(spark):
    rows = [(None, 1, 0, 0, 5, 5, 3), (None, 1, 6, 0, 5, 5, None), (1, None, 0, 0, 5, 5, 2), (1, 2, None, 0, 5, 5, 9), (1, 2, 0, 0, 5, 5, 9)]
    got = {tuple(r) for r in tracker.merge_components(spark.createDataFrame(rows, BOX)).collect()}
    assert got == {(None, 1, 0, 0, 11, 5, 3), (1, None, 0, 0, 5, 5, 2), (1, 2, None, 0, 5, 5, 9), (1, 2, 0, 0, 5, 5, 9)}
    assert tracker.merge_components(spark.createDataFrame([], BOX)).count() == 0
