"""Reading and writing the nested files around recordings: sidecars, taxonomies, id lists, shards.

Schemas are stated, never inferred, and hold every spelling that files use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POSITION = "struct<x:long,y:long,width:long,height:long,mass:long,frame_number:long,frameNumber:long,order:long,blank:boolean>"
TRACK = f"struct<id:long,start_s:double,start:double,end_s:double,`end`:double,tags:array<struct<what:string,confidence:double,automatic:boolean,path:string>>,positions:array<{POSITION}>>"
#: One schema for each spelling of the list of tracks: names that differ in case only cannot be in one.
SIDECARS = tuple(f"struct<id:long,stationId:long,deviceId:long,recordingDateTime:string,location:struct<lat:double,lng:double>,{name}:array<{TRACK}>>" for name in ("Tracks", "tracks"))


def parse_sidecars(texts: DataFrame, column: str = "value") -> DataFrame:
    """One row per position of every track: both spellings of each key, defaults for what is missing."""
    old, new = (F.from_json(column, schema) for schema in SIDECARS)
    clip = texts.select(old.alias("old"), new.alias("new"))
    tracks = clip.select(F.col("new.id").alias("clip_id"), F.col("new.stationId").alias("station_id"), F.posexplode_outer(F.coalesce("old.Tracks", "new.tracks")).alias("n", "t"))
    pos = tracks.select("clip_id", "station_id", F.coalesce("t.id", "n").alias("track_id"), F.coalesce("t.start_s", "t.start", F.lit(0.0)).alias("start_s"), F.posexplode_outer("t.positions").alias("i", "p"))
    frame = F.coalesce("p.frame_number", "p.frameNumber", "p.order")
    start = F.bround(F.col("start_s") * 9, 0).cast("long")
    return pos.select("clip_id", "station_id", "track_id", "i", F.coalesce(frame, start + F.col("i")).alias("frame_number"), "p.x", "p.y", "p.width", "p.height", F.coalesce("p.mass", F.lit(0)).alias("mass"), F.coalesce("p.blank", F.lit(False)).alias("blank"))


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    return parse_sidecars(spark.read.text(path, wholetext=True))


def parse_taxonomy(texts: DataFrame, column: str = "value") -> DataFrame:
    """label, path from one JSON object."""
    return texts.select(F.explode(F.from_json(column, "map<string,string>")).alias("label", "path"))


def parse_id_lists(lines: DataFrame, column: str = "value") -> DataFrame:
    """clip_id of comma-separated lines; what is not a number is left out."""
    part = lines.select(F.explode(F.split(column, ",")).alias("p"))
    return part.select(F.trim("p").try_cast("long").alias("clip_id")).where("clip_id is not null").distinct()


def decoded_positions(wire: DataFrame) -> DataFrame:
    """track_id, frame_number, box from arrays [left, top, right, bottom, frame or null]: first missing
    frames come from the start time, later ones follow the one before."""
    each = wire.select("track_id", "start_s", F.posexplode("positions").alias("i", "p"))
    box = lambda a, b: F.greatest(F.lit(0), F.get("p", F.lit(b)) - F.get("p", F.lit(a)))
    frame = F.coalesce(F.get("p", F.lit(4)), F.bround(F.col("start_s") * 9, 0).cast("long") + F.col("i"))
    return each.select("track_id", frame.alias("frame_number"), F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"), box(0, 2).alias("width"), box(1, 3).alias("height"))


def shard_of(source: Column, shards: int) -> Column:
    """The shard of a source: by hash, so that it does not change with the number of machines."""
    return (F.conv(F.substring(F.md5(source.cast("binary")), 1, 8), 16, 10).cast("long") % shards).cast("int")


def write_shards(samples: DataFrame, path: str, shards: int) -> None:
    """Compressed files by split and shard, rows in random order; what was there goes."""
    dealt = samples.withColumn("shard", shard_of(F.col("source_file"), shards)).repartition("split", "shard")
    dealt.sortWithinPartitions("split", "shard", F.md5(F.col("sample_id").cast("string").cast("binary"))).write.mode("overwrite").partitionBy("split", "shard").option("compression", "gzip").parquet(path)


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder where all machines see it (``spark.checkpoint.dir``); only where that is unset, as in tests, a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-")
    return f"{base}/trackspark/{what}-{uuid.uuid4().hex}"


def read_shards(spark: SparkSession, path: str, remap: dict[str, int] | None = None, least_mass: int = 0) -> DataFrame:
    """Records of written shards that have a mass of ``least_mass``, with idx: the label's number where it is remapped.

    Labels outside ``remap``, which is small, are left out."""
    rows = spark.read.parquet(path).where(F.col("mass") >= least_mass)
    if remap is None:
        return rows
    numbers = spark.createDataFrame(list(remap.items()), "label string, idx int")
    return rows.join(F.broadcast(numbers), "label")


def result_documents(tracks: DataFrame, predictions: DataFrame, thumbnails: DataFrame | None = None) -> DataFrame:
    """clip_id, document: nested JSON of a clip's tracks with their predictions.

    ``thumbnails`` (track_id, frame_number, score): every track tells its thumbnail, null if it has none."""
    preds = predictions.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("label", "confidence"))).alias("predictions"))
    told, joined = ["track_id", "start_frame", "end_frame", "num_regions", "predictions"], tracks.join(preds, "track_id", "left")
    if thumbnails is not None:
        region = F.struct("frame_number", F.round("score").cast("long").alias("score")).alias("thumbnail")
        told, joined = [*told, "thumbnail"], joined.join(thumbnails.select("track_id", region), "track_id", "left")
    one = joined.select("clip_id", F.struct(*told).alias("t"))
    return one.groupBy("clip_id").agg(F.to_json(F.struct(F.first("clip_id").alias("id"), F.array_sort(F.collect_list("t")).alias("tracks"))).alias("document"))


#: Keys of a document that a new version replaces as a whole, even by nothing.
REPLACED = ("tracks", "Tracks")


def merged_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """clip_id, document: new versions over old ones, key by key; tracks are those of the new version alone.

    Both have one row per clip.  A clip without a new version keeps its document as it is; an old document that
    is not a JSON object counts as none.  Merged documents name their keys in order.  Values are variants, so
    strings, numbers and nested objects stay what they are."""
    keyed = lambda docs, name: docs.select("clip_id", F.col("document").alias(name), F.from_json("document", "map<string,variant>").alias(f"{name}_keys"))
    both = keyed(old, "old").join(keyed(new, "new"), "clip_id", "full")
    known = F.coalesce("old_keys", F.from_json(F.lit("{}"), "map<string,variant>"))
    kept = F.map_filter(known, lambda k, _: ~k.isin(*REPLACED) & ~F.map_contains_key("new_keys", k))
    whole = both.withColumn("keys", F.map_concat(kept, "new_keys")).withColumn("names", F.array_sort(F.map_keys("keys")))
    text = F.to_json(F.map_from_arrays("names", F.transform("names", lambda k: F.element_at("keys", k))), {"ignoreNullFields": "false"})
    return whole.select("clip_id", F.when(F.col("new_keys").isNull(), F.col("old")).otherwise(text).alias("document"))
