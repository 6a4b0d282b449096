"""A camera's history goes through its step in small batches, whatever its length."""

import pytest

from trackspark.operators import tracker


@pytest.mark.parametrize("kind", ["throttle", "ir", "simple"])
def test_camera_is_folded_batch_by_batch(spark, kind):
    rows = [(c, 1000 * c + i, 3 * i, (i * (c + 3)) % 7 < 4) for c in (1, 2, 3) for i in range(200)]
    frames = spark.createDataFrame(rows[::-1], "camera long, event_id long, s long, motion boolean").selectExpr("camera", "event_id", "timestamp_seconds(s) as ts", "motion")
    want = {}
    for c in (1, 2, 3):
        mine = [r for r in rows if r[0] == c]
        if kind == "throttle":
            bucket = tracker.Bucket()
            flags = [bucket.step(r[2], r[3]) for r in mine]
        else:
            flags = tracker.hysteresis((r[3] for r in mine), *((30, 2) if kind == "ir" else (2, 1)))
        want |= dict(zip((r[1] for r in mine), flags, strict=True))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = tracker.per_camera(frames, kind)
        assert {r.event_id: r.flag for r in df.collect()} == want
        assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
