"""The files of many recordings are written by many tasks."""

from trackspark.plans import tables


def test_files_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables.d, "shared_folder", lambda _, what: str(tmp_path / what))
    got = sorted(r.stem for r in tables.s22(spark.range(30).withColumnRenamed("id", "clip_id")).collect())
    assert got == sorted([f"r{i}" for i in range(30) if i % 4 != 1 and i % 3 != 2] + [f"r{i}-track" for i in range(0, 30, 9)])
    for name in ("media", "sidecars"):
        tasks = {f.name.split("-")[1] for f in (tmp_path / "arrivals" / name).glob("stem=*/part-*")}
        assert len(tasks) > 1, f"one task wrote all {name}"
