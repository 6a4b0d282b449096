"""The choice of bins, and splits in which labels of many and of few tracks meet."""

from pyspark.sql import functions as F

from trackspark.plans import samples as s

SAMPLES = "sample_id long, clip_id long, track_id long, station_id long, label string, rec_time timestamp_ntz, source_file string, mass long"


def table(spark):
    """many: 120 tracks at 6 stations; few: 99 tracks at 6; near: 150 tracks at 3 stations only."""
    rows, n = [], 0
    for label, tracks, stations in (("many", 120, 6), ("few", 99, 6), ("near", 150, 3)):
        for t in range(tracks):
            clip = len(rows)
            for _ in range(2):
                rows.append((n, clip, clip * 10, t % stations, label, None, f"f{clip}", 5))
                n += 1
    return spark.createDataFrame(rows, SAMPLES)


def test_labels_of_few_tracks_or_stations_split_by_clip(spark):
    v = table(spark)
    kinds = {(r.label, r.k) for r in s.binned(v).select("label", F.substring("bin_id", 1, 1).alias("k")).distinct().collect()}
    assert kinds == {("many", "s"), ("few", "c"), ("near", "c")}
    assert {r.k for r in s.binned(v, 121).select(F.substring("bin_id", 1, 1).alias("k")).distinct().collect()} == {"c"}


def test_no_bin_is_divided_and_limits_hold(spark):
    v = table(spark)
    out = s.group_split(v)
    assert out.count() == v.count() and out.select("sample_id").distinct().count() == v.count()
    told = s.binned(v).join(out, "sample_id")
    assert told.groupBy("bin_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    by = {(r.label, r.split): (r.n, r.t) for r in told.groupBy("label", "split").agg(F.count("*").alias("n"), F.countDistinct("track_id").alias("t")).collect()}
    for label in ("few", "near"):  # bins are single clips, so the limits are met nearly exactly
        assert by[label, "validation"][0] in (100, 102) and by[label, "validation"][1] >= 50 and by[label, "test"][0] in (40, 42) and by[label, "train"][0] > 0
    assert by["many", "validation"][0] >= 100 and by["many", "validation"][1] >= 50
