"""Files around recordings: odd spellings, missing keys, lines that cannot be read."""

import json

from trackspark.sources import documents as d


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_sidecars_with_both_spellings(spark, tmp_path):
    box = {"x": 1, "y": 2, "width": 3, "height": 4}
    old = {"id": 7, "Tracks": [{"id": 1, "start": 1.0, "positions": [box | {"order": 5, "mass": 9}, box]}]}
    new = {"id": 8, "tracks": [{"start_s": 2.0, "positions": [box | {"frameNumber": 30, "blank": True}]}, {"id": 4}]}
    for name, body in (("a.txt", old), ("b.txt", new), ("c.txt", {"id": 9})):
        (tmp_path / name).write_text(json.dumps(body, indent=1))
    got = rows_of(d.read_sidecars(spark, str(tmp_path)), "clip_id", "track_id", "frame_number", "x", "mass", "blank")
    assert got == sorted([(7, 1, 5, 1, 9, False), (7, 1, 10, 1, 0, False), (8, 0, 30, 1, 0, True), (8, 4, None, None, 0, False), (9, None, None, None, 0, False)], key=repr)


def test_id_lists_and_taxonomy(spark):
    lines = spark.createDataFrame([("1, 2,,x",), ("",), (None,), ("2,30",)], "value string")
    assert rows_of(d.parse_id_lists(lines), "clip_id") == [(1,), (2,), (30,)]
    assert rows_of(d.parse_taxonomy(spark.createDataFrame([('{"rat": "all.mammal.rodent.rat"}',)], "value string")), "label", "path") == [("rat", "all.mammal.rodent.rat")]


def test_shards_are_written_and_replaced(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"clip-{i % 5}", "train" if i % 2 else "test") for i in range(60)], "sample_id long, source_file string, split string")
    for _ in range(2):
        d.write_shards(rows, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 60 and back.groupBy("source_file").agg({"shard": "min"}).count() == 5
    assert back.select("source_file", "shard").distinct().count() == 5
