"""A track store on disk: what changes, what stays as it was, and calls that are made again."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from trackspark.sources.store import BOX, SCHEMAS, UPDATES, TrackStore

REGIONS = "clip_id long, track_id long, frame_number long, x long, y long, width long, height long, mass long, blank boolean"


def region(clip, track, frame, blank=False):
    return clip, track, frame, frame, 2, 3, 4, 10 * frame, blank


@pytest.fixture
def store(spark, tmp_path):
    rows = [region(c, c * 10 + t, f, f == 3) for c in range(12) for t in range(2) for f in range(5)]
    frames = spark.createDataFrame([(c, f, [float(f)]) for c in range(12) for t in range(2) for f in range(5)][:-5], "clip_id long, frame_number long, pixels array<double>")
    return TrackStore(spark, str(tmp_path / "store"), 5).create(spark.createDataFrame(rows, REGIONS), frames)


def files(store, name):
    """part -> names of its files: a partition that was rewritten has others."""
    out = {}
    for f in glob.glob(f"{store.path}/{name}/part=*/*.parquet"):
        out.setdefault(int(f.split("part=")[1].split("/")[0]), set()).add(os.path.basename(f))
    return out


def ids(spark, *rows, ddl="clip_id long, track_id long"):
    return spark.createDataFrame(list(rows), ddl)


def part_of(store, clip):
    return store.table("clips").where(F.col("clip_id") == clip).first().part


def test_removed_tracks_leave_other_partitions_alone(spark, store):
    before = files(store, "regions")
    told = store.remove_tracks(ids(spark, (3, 30), (3, 30), (3, 99), (77, 1)))
    assert {(r.clip_id, r.track_id, r.found, r.removed) for r in told.collect()} == {(3, 30, True, True), (3, 99, True, False), (77, 1, False, False)}
    after, hit = files(store, "regions"), part_of(store, 3)
    assert {p for p in before if before[p] != after.get(p)} == {hit}
    assert store.table("regions").where("track_id = 30").count() == 0 and store.table("regions").count() == 115 and store.table("tracks").count() == 23
    again = store.remove_tracks(ids(spark, (3, 30), (3, 99), (77, 1)))
    assert {(r.track_id, r.found, r.removed) for r in again.collect()} == {(30, True, False), (99, True, False), (1, False, False)} and files(store, "regions") == after
    assert {(r.track_id, r.removed) for r in told.collect()} == {(30, True), (99, False), (1, False)}, "the answer stays as it was given"


def test_removed_clips_and_partitions_that_become_empty(spark, store):
    hit = part_of(store, 4)
    own = [r.clip_id for r in store.table("clips").where(F.col("part") == hit).collect()]
    told = store.remove_clips(ids(spark, *[(c,) for c in own], (500,), ddl="clip_id long"))
    assert {r.clip_id: r.found for r in told.collect()} == {c: True for c in own} | {500: False}
    for name in ("clips", "tracks", "regions", "frames"):
        assert hit not in files(store, name) and store.table(name).join(ids(spark, *[(c,) for c in own], ddl="clip_id long"), "clip_id").count() == 0
    store.remove_clips(ids(spark, *[(c,) for c in range(12)], ddl="clip_id long"))
    assert all(store.table(name).count() == 0 for name in SCHEMAS)
    assert {r.found for r in store.remove_clips(ids(spark, (1,), ddl="clip_id long")).collect()} == {False}


def updates(spark, *rows):
    return spark.createDataFrame([(seq, clip, track, tag, own, *region(clip, track, frame, blank)[2:]) for seq, clip, track, tag, own, frame, blank in rows], UPDATES)


def tagged(store):
    frames = {(r.clip_id, r.tag): r.f for r in store.table("tag_frames").groupBy("clip_id", "tag").agg(F.array_sort(F.collect_list("frame_number")).alias("f")).collect()}
    regions = {(r.clip_id, r.tag): r.f for r in store.table("tag_regions").groupBy("clip_id", "tag").agg(F.array_sort(F.collect_list("frame_number")).alias("f")).collect()}
    clips = {r.clip_id: r.tag for r in store.table("clips").where("tag is not null").collect()}
    tracks = {r.track_id: (r.tag, r.tag_confirmed) for r in store.table("tracks").where("tag is not null or tag_confirmed").collect()}
    return frames, regions, clips, tracks


def test_tags_merge_frames_and_regions(spark, store):
    first = updates(spark, (1, 2, 20, "cat", "cat", 4, False), (1, 2, 20, "cat", "cat", 1, False), (1, 2, 20, "cat", "cat", 3, True), (1, 2, 20, "cat", "cat", 4, False))
    assert [(r.clip_id, r.found) for r in store.update_tags(first).collect()] == [(2, True)]
    assert tagged(store) == ({(2, "cat"): [1, 3, 4]}, {(2, "cat"): [1, 4]}, {2: "cat"}, {20: ("cat", True)})
    kept = {name: files(store, name) for name in SCHEMAS}
    store.update_tags(first)
    assert {name: files(store, name) for name in SCHEMAS} == kept, "nothing is written when all is there"
    told = store.update_tags(updates(spark, (2, 2, 21, "cat", "dog", 2, False), (3, 2, 20, "cat", None, 1, False), (4, 2, 20, "fox", "fox", 0, False), (1, 90, 1, "cat", "cat", 1, False)))
    assert {r.clip_id: r.found for r in told.collect()} == {2: True, 90: False}
    assert tagged(store) == ({(2, "cat"): [1, 2, 3, 4], (2, "fox"): [0]}, {(2, "cat"): [1, 4], (2, "fox"): [0]}, {2: "fox"}, {20: ("fox", True), 21: ("dog", True)})
    assert {p for p, f in files(store, "tracks").items() if f != kept["tracks"][p]} == {part_of(store, 2)}
    store.remove_tags(ids(spark, (2, 20)))
    assert tagged(store) == ({}, {}, {}, {20: ("fox", False), 21: ("dog", True)})


def test_frames_are_compacted_where_tracks_share_them(spark, store):
    once = 11  # of this clip every frame is there once
    before, hit = files(store, "frames"), part_of(store, once)
    rewritten = store.compact_frames()
    shared = {r.part for r in store.table("clips").where(F.col("clip_id") != once).collect()}
    assert set(rewritten) == shared and store.table("frames").count() == 12 * 5
    assert {p for p, f in files(store, "frames").items() if f == before[p]} == {hit} - shared
    assert store.table("frames").where("pixels[0] <> frame_number").count() == 0
    after = files(store, "frames")
    assert store.compact_frames() == [] and files(store, "frames") == after


def test_rows_with_nulls_and_an_empty_store(spark, tmp_path):
    store = TrackStore(spark, str(tmp_path / "s"), 3).create(spark.createDataFrame([(None, 1, 0, 0, 0, 1, 1, None, None), region(1, 1, 0)], REGIONS))
    assert [r.found for r in store.remove_clips(ids(spark, (None,), ddl="clip_id long")).collect()] == [False], "a null id names no clip"
    assert store.table("regions").count() == 2
    empty = TrackStore(spark, str(tmp_path / "e"), 3).create(spark.createDataFrame([], REGIONS))
    assert empty.table("regions").count() == 0 and empty.compact_frames() == [] and [r.found for r in empty.update_tags(updates(spark, (1, 2, 20, "a", "a", 1, False))).collect()] == [False]
    assert set(BOX) <= set(empty.table("tag_regions").columns)
