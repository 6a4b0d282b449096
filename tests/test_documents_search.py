"""Merging of result documents, and the search that goes on where it was interrupted."""

import json

import pytest
from pyspark.sql import functions as F

from trackspark.operators import models as m
from trackspark.sources import documents as d


def test_merged_documents(spark):
    old = {
        1: '{"id":1,"note":{"z":1,"a":[1.5,"2",null]},"tracks":[1,2],"Tracks":[],"s":"1","n":1,"same":"old","gone":null}',
        2: '{"id":2,"tracks":[9]}', 4: "not json", 5: None, 6: "[1]", 7: "{}", 8: '{"a \\"b\\"":"é\\n"}',
    }
    new = {1: '{"same":{"k":"new"},"tracks":[{"id":3}]}', 3: '{"tracks":[]}', 4: '{"x":1}', 5: '{"x":1}', 6: '{"x":1}', 7: '{"same":null}', 8: "{}"}
    frame = lambda rows: spark.createDataFrame([(k, v, 0) for k, v in rows.items()], "clip_id long, document string, extra int")
    got = {r.clip_id: r.document for r in d.merged_documents(frame(old), frame(new)).collect()}
    want = {k: json.loads(v) for k, v in new.items()}
    for k in (1, 7, 8):
        want[k] = {x: y for x, y in json.loads(old[k]).items() if x not in ("tracks", "Tracks")} | want[k]
    assert got.pop(2) == old[2], "no new version: as it was"
    assert {k: json.loads(v) for k, v in got.items()} == want
    assert list(json.loads(got[1])) == sorted(want[1])
    assert d.merged_documents(frame(old).limit(0), frame(new).limit(0)).count() == 0


def test_documents_with_thumbnails(spark):
    tracks = spark.createDataFrame([(1, 10, 0, 5, 6), (1, 11, 2, 3, 2)], "clip_id long, track_id long, start_frame int, end_frame int, num_regions int")
    preds = spark.createDataFrame([(10, 2, 0.5)], "track_id long, label int, confidence double")
    thumbs = spark.createDataFrame([(10, 4, 80.6)], "track_id long, frame_number int, score double")
    (row,) = d.result_documents(tracks, preds, thumbs).collect()
    first, second = json.loads(row.document)["tracks"]
    assert first["thumbnail"] == {"frame_number": 4, "score": 81} and first["predictions"] == [{"label": 2, "confidence": 0.5}]
    assert "thumbnail" not in second or second["thumbnail"] is None


def test_axis_search_goes_on(spark, tmp_path, monkeypatch):
    rows = [([float(i % 7), float(i * i % 11)], int(i % 7 > 3)) for i in range(120)]
    features, path = spark.createDataFrame(rows, "features array<double>, label int"), str(tmp_path / "log")
    fitted, forest = [], m.forest

    def counted(found, trees, depth):
        if len(fitted) == 2:
            raise RuntimeError("lost")
        fitted.append((trees, depth))
        return forest(found, trees, depth)

    monkeypatch.setattr(m, "forest", counted)
    axes = {"trees": [3, 5], "depth": [1]}
    with pytest.raises(RuntimeError):
        m.axis_search(features, axes, path)
    assert {r.job for r in spark.read.parquet(path).collect()} == {"reference", "trees=3"}
    monkeypatch.setattr(m, "forest", lambda *a: fitted.append(a[1:]) or forest(*a))
    got = {r.job: r for r in m.axis_search(features, axes, path).collect()}
    assert fitted == [(10, 5), (3, 5), (5, 5), (10, 1)], "finished jobs are not run again"
    assert {k: (r.trees, r.depth) for k, r in got.items()} == {"reference": (10, 5), "trees=3": (3, 5), "trees=5": (5, 5), "depth=1": (10, 1)}
    assert m.axis_search(features, axes, path).count() == 4 and len(fitted) == 4
    # accuracy, counted row by row
    tested = features.where(m.held_out(features))
    scored = m.forest_scores(forest(features.where(~m.held_out(features)), 10, 1), tested, "label").collect()
    assert 0 < len(scored) < 120 and got["depth=1"].accuracy == pytest.approx(sum(r.pred == r.label for r in scored) / len(scored))
    assert m.axis_search(features.where(F.lit(False)), axes, str(tmp_path / "none")).count() == 0
