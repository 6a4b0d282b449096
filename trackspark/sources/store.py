"""A stored set of track tables that can be changed: tracks and clips deleted, tags put in, frames compacted.

Tables are Parquet folders partitioned by ``part``, a hash of the clip; rows of a partition are sorted by clip,
so that footers tell which row groups hold one.  A change rewrites the partitions that hold what it changes and no
others: they are read by partition filter, and written by dynamic partition overwrite, which stages the new
files and swaps folders when all tasks have ended; partitions that become empty are dropped.  A call that finds nothing to change
writes nothing, so calls can be repeated after a failure.  One writer at a time.

Tables: ``clips`` (clip_id, tag), ``tracks`` (clip_id, track_id, tag, tag_confirmed), ``regions`` (clip_id, track_id, frame_number
and the box), ``frames`` (clip_id, frame_number and any payload), ``tag_frames`` (clip_id, tag, frame_number), ``tag_regions``
(clip_id, tag, frame_number and the box).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = ("x", "y", "width", "height", "mass", "blank")
_BOX_DDL = "x long, y long, width long, height long, mass long, blank boolean"
SCHEMAS = {
    "clips": "clip_id long, tag string",
    "tracks": "clip_id long, track_id long, tag string, tag_confirmed boolean",
    "regions": f"clip_id long, track_id long, frame_number long, {_BOX_DDL}",
    "frames": "clip_id long, frame_number long",
    "tag_frames": "clip_id long, tag string, frame_number long",
    "tag_regions": f"clip_id long, tag string, frame_number long, {_BOX_DDL}",
}
UPDATES = f"seq long, clip_id long, track_id long, clip_tag string, track_tag string, frame_number long, {_BOX_DDL}"


class TrackStore:
    """``parts`` is stated by whoever opens a store, and must be what it was made with."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 64) -> None:
        self.spark, self.path, self.parts = spark, path, parts

    # --- tables ---

    def _part(self) -> F.Column:
        return F.pmod(F.hash(F.col("clip_id").cast("long")), F.lit(self.parts)).alias("part")

    def _fs(self, what: str) -> tuple:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def table(self, name: str) -> DataFrame:
        """A table as it lies there now, with ``part``; one that nothing was written to is empty."""
        fs, where = self._fs(name)
        if not fs.exists(where) or not any(f.isDirectory() and f.getPath().getName().startswith("part=") for f in fs.listStatus(where)):
            return self.spark.createDataFrame([], f"{SCHEMAS[name]}, part int")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _write(self, rows: DataFrame, name: str) -> None:
        """Put whole partitions in the place of those that are there."""
        ordered = [c for c in ("clip_id", "track_id", "tag", "frame_number") if c in rows.columns]
        dealt = rows.withColumn("part", self._part()).repartition("part").sortWithinPartitions("part", *ordered)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/{name}")

    def create(self, regions: DataFrame, frames: DataFrame | None = None) -> TrackStore:
        """Fill the tables from regions (clip_id, track_id, frame_number and the box), and frames of tracks as they come."""
        self._write(regions.select("clip_id", "track_id", "frame_number", *BOX), "regions")
        none = F.lit(None).cast("string").alias("tag")
        self._write(regions.select("clip_id", "track_id", none, F.lit(False).alias("tag_confirmed")).distinct(), "tracks")
        self._write(regions.select("clip_id", none).distinct(), "clips")
        if frames is not None:
            self._write(frames, "frames")
        return self

    def _parts_of(self, rows: DataFrame) -> list[int]:
        """The partitions that hold the clips of ``rows``: at most ``parts`` numbers."""
        return sorted(r.part for r in rows.select(self._part()).distinct().collect())

    def _rewrite(self, name: str, parts: list[int], rows: DataFrame) -> list[int]:
        """Let ``rows`` be what the partitions hold; those that get none go."""
        if parts:
            left = self._parts_of(rows)
            self._write(rows, name)
            for p in set(parts) - set(left):
                fs, where = self._fs(f"{name}/part={p}")
                fs.delete(where, True)
        return parts

    def _held(self, name: str, parts: list[int]) -> DataFrame:
        return self.table(name).where(F.col("part").isin(parts)).drop("part")

    # --- changes ---

    def _remove(self, name: str, keys: DataFrame, by: list[str]) -> list[int]:
        parts = self._parts_of(self.table(name).join(keys, by, "left_semi"))
        return self._rewrite(name, parts, self._held(name, parts).join(keys, by, "left_anti"))

    def _add(self, name: str, rows: DataFrame) -> list[int]:
        """Put rows in that are not there; equal rows count once."""
        there = self.table(name).drop("part")
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in there.columns]
        fresh = rows.select(*there.columns).distinct().alias("n").join(there.alias("o"), same, "left_anti")
        parts = self._parts_of(fresh)
        return self._rewrite(name, parts, self._held(name, parts).unionByName(fresh))

    def _set(self, name: str, values: DataFrame, by: list[str]) -> list[int]:
        """Give the rows that ``values`` (one row a key) names its other columns."""
        columns = [c for c in values.columns if c not in by]
        new = values.select(*by, *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_named"))
        differs = [~F.col(c).eqNullSafe(F.col(f"_new_{c}")) for c in columns]
        any_ = differs[0]
        for d in differs[1:]:
            any_ = any_ | d
        parts = self._parts_of(self.table(name).join(new, by).where(any_))
        held = self._held(name, parts)
        changed = held.join(new, by, "left")
        return self._rewrite(name, parts, changed.select(*(F.when(F.col("_named"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in held.columns)))

    def remove_tracks(self, keys: DataFrame) -> DataFrame:
        """clip_id, track_id, found (the clip is in the store), removed (so was the track), for each distinct key; all its rows go."""
        keys = keys.select("clip_id", "track_id").distinct()
        clips = self.table("clips").select("clip_id", F.lit(True).alias("_c"))
        tracks = self.table("tracks").select("clip_id", "track_id", F.lit(True).alias("_t"))
        told = self._kept(keys.join(clips, "clip_id", "left").join(tracks, ["clip_id", "track_id"], "left").select("clip_id", "track_id", F.coalesce("_c", F.lit(False)).alias("found"), F.coalesce("_t", F.lit(False)).alias("removed")))
        gone = told.where("removed").select("clip_id", "track_id")
        for name in ("regions", "tracks"):  # the table that tells what was found comes last: a failed call can be repeated
            self._remove(name, gone, ["clip_id", "track_id"])
        return told

    def remove_clips(self, ids: DataFrame) -> DataFrame:
        """clip_id, found, for each distinct id; all rows of the clip go from all tables."""
        clips = self.table("clips").select("clip_id", F.lit(True).alias("_c"))
        told = self._kept(ids.select("clip_id").distinct().join(clips, "clip_id", "left").select("clip_id", F.coalesce("_c", F.lit(False)).alias("found")))
        gone = told.where("found").select("clip_id")
        for name in ("tag_regions", "tag_frames", "frames", "regions", "tracks", "clips"):
            self._remove(name, gone, ["clip_id"])
        return told

    def update_tags(self, updates: DataFrame) -> DataFrame:
        """Put human tags in: rows of UPDATES, one per tagged frame and region of a track; gives clip_id, found.

        The frames of a clip's tag, and, where the track has the same tag, its regions that are not blank, are added to those that are
        there, each once.  The clip takes the tag, the track its own if it has one, and is then confirmed; of several the highest ``seq`` counts.
        Updates of clips that are not in the store are told and left out."""
        updates = self._kept(updates)
        clips = self.table("clips").select("clip_id", F.lit(True).alias("_c"))
        told = self._kept(updates.select("clip_id").distinct().join(clips, "clip_id", "left").select("clip_id", F.coalesce("_c", F.lit(False)).alias("found")))
        known = updates.join(told.where("found").select("clip_id"), "clip_id", "left_semi").withColumn("tag", F.col("clip_tag"))
        self._add("tag_frames", known)
        self._add("tag_regions", known.where("clip_tag = track_tag and not blank"))
        own = known.where("track_tag is not null").groupBy("clip_id", "track_id").agg(F.max_by("track_tag", "seq").alias("tag"))
        self._set("tracks", own.withColumn("tag_confirmed", F.lit(True)), ["clip_id", "track_id"])
        self._set("clips", known.groupBy("clip_id").agg(F.max_by("clip_tag", "seq").alias("tag")), ["clip_id"])
        return told

    def remove_tags(self, keys: DataFrame) -> None:
        """Take the human tags of clips away; the tracks named (clip_id, track_id) are no longer confirmed."""
        keys = self._kept(keys.select("clip_id", "track_id").distinct())
        clips = keys.select("clip_id").distinct()
        for name in ("tag_regions", "tag_frames"):
            self._remove(name, clips, ["clip_id"])
        self._set("tracks", keys.withColumn("tag_confirmed", F.lit(False)), ["clip_id", "track_id"])
        self._set("clips", clips.withColumn("tag", F.lit(None).cast("string")), ["clip_id"])

    def compact_frames(self) -> list[int]:
        """Keep one of the frames that tracks of a clip share (of different contents the least); gives the partitions that had any."""
        frames = self.table("frames")
        twice = frames.groupBy("part", "clip_id", "frame_number").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        parts = sorted(r.part for r in twice.select("part").distinct().collect())
        rest = [c for c in frames.columns if c not in ("clip_id", "frame_number", "part")]
        one = self._held("frames", parts).groupBy("clip_id", "frame_number").agg(F.min(F.struct(*rest) if rest else F.lit(0)).alias("_f"))
        return self._rewrite("frames", parts, one.select("clip_id", "frame_number", *([f"_f.{c}" for c in rest])))

    def _kept(self, rows: DataFrame) -> DataFrame:
        """Written beside the tables: an answer, or what a call asks for, that must not change while tables do."""
        path = f"{self.path}/calls/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)
