"""Finished recordings: files that arrive in a folder are paired, processed again with all their frames, and told as final.

A recording is complete when its media file and its sidecar are there, in whatever order they came, or when its name
ends in ``-track``.  Batches of complete recordings are scored and written under their number: a batch that runs again after a failure
takes the place of what it had written, and a query that is started again goes on behind its last batch, so each recording gives
its events once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trackspark.operators import models

#: One line per frame of a track, its pixels row by row.
MEDIA = "track_id long, frame_number long, width int, pixels array<double>, border int"
EVENTS = "stem string, track_id long, label string, score double, tag string, version int, final boolean"


def stem_of(path: Column) -> Column:
    """The file's name without ending, or the folder ``stem=...`` that a writer put it in."""
    own = F.regexp_extract(path, r"/stem=([^/]+)/", 1)
    return F.when(own != "", own).otherwise(F.regexp_extract(path, r"([^/]+?)(\.[^/.]*)?$", 1))


def arrivals(spark: SparkSession, folder: str, files: str = "*", most: int = 1000) -> DataFrame:
    """stem, path, ts of files as they arrive; their contents are not read here."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", files).option("maxFilesPerTrigger", most).load(folder)
    return found.select(stem_of(F.col("path")).alias("stem"), "path", F.col("modificationTime").alias("ts"))


def complete(media: DataFrame, sidecars: DataFrame, within: str = "1 day") -> DataFrame:
    """stem, path of media files once they are complete; files of a pair may come ``within`` each other."""
    m = media.withWatermark("ts", within)
    s = sidecars.select(F.col("stem").alias("_stem"), F.col("ts").alias("_ts")).withWatermark("_ts", within)
    near = f"stem = _stem and _ts between ts - interval {within} and ts + interval {within}"
    whole = F.col("stem").endswith("-track")
    return m.where(~whole).join(s.where(~F.col("_stem").endswith("-track")), F.expr(near)).select("stem", "path").unionByName(m.where(whole).select("stem", "path"))


def frames_of(paths: DataFrame) -> DataFrame:
    """The frames of media files, of which a batch names no more than it may take in: stem and the columns of MEDIA."""
    spark = paths.sparkSession
    rows = [r.path for r in paths.select("path").distinct().collect()]  # at most maxFilesPerTrigger of each source
    if not rows:
        return spark.createDataFrame([], f"stem string, {MEDIA}")
    return spark.read.schema(MEDIA).json(rows).withColumn("stem", stem_of(F.col("_metadata.file_path")))


def final_events(frames: DataFrame, model: models.Model) -> DataFrame:
    """EVENTS: every track of every recording scored over all its frames."""
    keyed = frames.withColumn("_key", F.struct("stem", "track_id"))
    cells = keyed.select(F.col("_key").alias("track_id"), "frame_number", "width", "border", F.size("pixels").alias("_n"), F.posexplode("pixels").alias("_at", "v"))
    y, x, b = F.floor(F.col("_at") / F.col("width")), F.col("_at") % F.col("width"), F.col("border")
    inside = (y >= b) & (y < F.col("_n") / F.col("width") - b) & (x >= b) & (x < F.col("width") - b)
    found = models.patches(cells.select("track_id", "frame_number", y.alias("y"), x.alias("x"), "v", inside.alias("inside")))
    out = models.classify_tracks(found.withColumn("track_id", F.to_json("track_id")), model).withColumn("_key", F.from_json("track_id", "stem string, track_id long"))
    return out.select("_key.stem", "_key.track_id", "label", "score", "tag", "version", F.lit(True).alias("final"))


def reprocess(recordings: DataFrame, model: models.Model, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Score complete recordings (stem, path) batch by batch; EVENTS go to ``path``, in a folder per batch."""

    def batch(rows: DataFrame, number: int) -> None:
        final_events(frames_of(rows.dropDuplicates(["stem", "path"])), model).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = recordings.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def events(spark: SparkSession, path: str) -> DataFrame:
    """The events that were told so far."""
    return spark.read.schema(EVENTS).option("recursiveFileLookup", "true").parquet(path)
