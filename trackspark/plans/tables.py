"""s01-s04, s09, s16-s18, s22-s25, x16, x18: files and tables around recordings."""

from pyspark.sql import functions as F

from trackspark.functions import geometry as g
from trackspark.operators import predictions as p
from trackspark.sources import documents as d
from trackspark.sources.store import TrackStore
from trackspark.streaming import finished

from .base import query, r6
from .predictions import SMOOTH, THUMBNAILS, k06
from .samples import split


def sidecars(v):
    """A JSON text per clip as recorders write it; the spelling of keys differs by clip."""
    old, track = F.col("clip_id") % 2 == 0, ("clip_id", "track_id")
    pos = F.struct("x", "y", "width", "height", "mass", F.when(old, F.col("frame_number")).alias("frame_number"), F.when(~old, F.col("frame_number")).alias("frameNumber"), "blank")
    tracks = v.groupBy(*track).agg(F.array_sort(F.collect_list(F.struct("frame_number", pos.alias("p")))).alias("ps"))
    one = tracks.select("clip_id", F.struct(F.col("track_id").alias("id"), F.transform("ps", lambda x: x["p"]).alias("positions")).alias("t"))
    clips = one.groupBy("clip_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return clips.select(F.to_json(F.struct(F.col("clip_id").alias("id"), (F.col("clip_id") % 10).alias("stationId"), F.when(old, F.col("ts")).alias("Tracks"), F.when(~old, F.col("ts")).alias("tracks"))).alias("value"))


@query("s01_read_sidecars", "v_regions", sql="select clip_id, clip_id%10 as station_id, track_id, frame_number, x, y, width, height, mass, blank from v_regions")
def s01(v):
    return d.parse_sidecars(sidecars(v)).drop("i")


@query("s02_decode_positions", "v_regions", sql="select track_id, frame_number+case when track_id%2=0 then 2 else 0 end as frame_number, x, y, width, height from v_regions")
def s02(v):
    known = F.when(F.col("track_id") % 2 == 1, F.col("frame_number"))
    b = g.box()
    wire = v.groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_number", F.array(b.x, b.y, b.right, b.bottom, known).alias("p")))), lambda s: s["p"]).alias("positions"))
    return d.decoded_positions(wire.withColumn("start_s", F.lit(0.25)))


@query("s03_label_taxonomy", "v_tags", sql="select distinct what as label, path from v_tags")
def s03(t):
    pairs = t.select("what", "path").distinct().agg(F.map_from_entries(F.collect_list(F.struct("what", "path"))).alias("m"))  # one entry per label
    return d.parse_taxonomy(pairs.select(F.to_json("m").alias("value")))


@query("s04_clip_id_lists", "v_clips", sql="select distinct clip_id from v_clips")
def s04(c):
    lines = c.groupBy("station_id").agg(F.concat(F.array_join(F.collect_list("clip_id").cast("array<string>"), ", "), F.lit(",, oops")).alias("value"))
    return d.parse_id_lists(lines)


@query("s09_training_shards", "v_samples", sql="s as (select sample_id, case when sample_id%20<16 then 'train' when sample_id%20<19 then 'validation' else 'test' end as split, cast(('0x'||substr(md5(source_file),1,8)) as bigint)%8 as shard from v_samples) select split, cast(shard as integer) as shard, count(*) as n from s group by 1,2")
def s09(v):
    """Shards are written, and counted as they lie there."""
    path = d.shared_folder(v.sparkSession, "shards")
    d.write_shards(split(v), path, 8)
    return v.sparkSession.read.parquet(path).groupBy("split", F.col("shard").cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("s16_bulk_ingest", "v_tracks", sql="select clip_id, track_id, greatest(0, start_frame-case when track_id%2=0 then 1 else 0 end) as start_frame, least(60, end_frame) as end_frame from v_tracks where clip_id not in (select clip_id from v_tracks where clip_id%5=2) and num_regions>0")
def s16(v):
    loaded = v.where("clip_id % 5 = 2").select("clip_id").distinct()
    shift = F.when(F.col("track_id") % 2 == 0, 1).otherwise(0)
    return v.where("num_regions > 0").join(loaded, "clip_id", "left_anti").select("clip_id", "track_id", F.greatest(F.lit(0), F.col("start_frame") - shift).alias("start_frame"), F.least(F.lit(60), F.col("end_frame")).alias("end_frame"))


@query("s17_compact_frames", "v_regions", sql="select clip_id, frame_number, min(mass) as mass from v_regions group by 1,2")
def s17(v):
    """A store to which every track of a clip brought its own copy of the frames, after compaction."""
    frames = v.select("clip_id", "frame_number", "mass")
    store = TrackStore(v.sparkSession, d.shared_folder(v.sparkSession, "store"), 16).create(v, frames)
    store.compact_frames()
    return store.table("frames").select("clip_id", "frame_number", "mass")


@query("s18_result_documents", "v_predictions", "v_tracks", sql=SMOOTH.rstrip() + """,
d as (select t.clip_id, '{"track_id":'||t.track_id||',"start_frame":'||start_frame||',"end_frame":'||end_frame||',"num_regions":'||num_regions||case when label_1 is null then '' else ',"predictions":[{"label":'||label_1||',"confidence":'||round(score_1, 6)||'}]' end||'}' as doc, t.track_id from v_tracks t left join b using (track_id))
select clip_id, '{"id":'||clip_id||',"tracks":['||string_agg(doc, ',' order by track_id)||']}' as document from d group by clip_id""")
def s18(v, tracks):
    best = p.best(p.track_scores(v)).select("track_id", F.col("label_1").alias("label"), r6("score_1").alias("confidence"))
    return d.result_documents(tracks, best)


@query("s18_merged_documents", "v_predictions", "v_tracks", "v_regions", sql=THUMBNAILS.rstrip() + """,
c as (select clip_id, count(*) as n, count(thumb.track_id) as with_thumb, sum(thumb.frame_number) as thumb_frames, sum(round(thumb.score)) as thumb_scores from v_tracks left join thumb using (track_id) group by clip_id)
select clip_id, case when clip_id%4=0 then 'Tracks,camera,id,note,source,tracks' when clip_id%3=0 then 'id,source,tracks' else 'camera,id,note,source,tracks' end as keys,
 case when clip_id%4=0 or clip_id%3<>0 then 'cam "'||clip_id%7||'"' end as camera, case when clip_id%4=0 then 'first' else 'second' end as source, case when clip_id%4=0 then 1 else n end as n_tracks,
 case when clip_id%4=0 then 0 else with_thumb end as n_thumbnails, case when clip_id%4<>0 then cast(thumb_frames as bigint) end as thumbnail_frames, case when clip_id%4<>0 then cast(thumb_scores as bigint) end as thumbnail_scores
from c where clip_id%4<>0 or clip_id%3<>0""")
def s18_merged(v, tracks, regions):
    """First versions of two clips in three, tracked anew for three in four; what the merged documents say is read back from their text."""
    clip, empty = F.col("clip_id"), F.array(F.lit(0))
    camera = F.concat(F.lit('cam "'), clip % 7, F.lit('"')).alias("camera")
    first = F.struct(clip.alias("id"), camera, F.lit("first").alias("source"), F.struct(clip.alias("by")).alias("note"), empty.alias("tracks"), empty.alias("Tracks"))
    old = tracks.select("clip_id").distinct().where("clip_id % 3 <> 0").select("clip_id", F.to_json(first).alias("document"))
    best = p.best(p.track_scores(v)).select("track_id", F.col("label_1").alias("label"), r6("score_1").alias("confidence"))
    found = d.result_documents(tracks.where("clip_id % 4 <> 0"), best, k06(regions))
    new = found.select("clip_id", F.regexp_replace("document", "^[{]", '{"source":"second",').alias("document"))
    text = F.col("document")
    thumbs = F.from_json(F.get_json_object(text, "$.tracks"), "array<struct<thumbnail: struct<frame_number: bigint, score: bigint>>>")
    shown = F.filter(F.col("thumbs.thumbnail"), lambda t: t.isNotNull())
    total = lambda name: F.when(F.size("shown") > 0, F.aggregate(F.col(f"shown.{name}"), F.lit(0).cast("long"), lambda a, x: a + x))
    read = d.merged_documents(old, new).withColumn("thumbs", F.when(F.get_json_object(text, "$.source") == "second", thumbs)).withColumn("shown", F.coalesce(shown, F.array().cast("array<struct<frame_number: bigint, score: bigint>>")))
    return read.select(
        "clip_id", F.array_join(F.array_sort(F.json_object_keys(text)), ",").alias("keys"), F.get_json_object(text, "$.camera").alias("camera"), F.get_json_object(text, "$.source").alias("source"),
        F.json_array_length(F.get_json_object(text, "$.tracks")).cast("long").alias("n_tracks"), F.size("shown").cast("long").alias("n_thumbnails"), total("frame_number").alias("thumbnail_frames"), total("score").alias("thumbnail_scores"),
    )


@query("s22_finished_recordings", "v_clips", sql="select 'r'||clip_id as stem from v_clips where clip_id%4<>1 and clip_id%3<>2 union all select 'r'||clip_id||'-track' from v_clips where clip_id%9=0")
def s22(c):
    """Media files and sidecars in folders, watched by two streams: of some recordings only one of the two is there, and some need no sidecar.

    Rows are small and files many: with a number of its own the shuffle is not drawn together into one task that writes them all."""
    spark, path = c.sparkSession, d.shared_folder(c.sparkSession, "arrivals")
    stem, body = F.concat(F.lit("r"), "clip_id"), F.to_json(F.struct("clip_id")).alias("value")
    media = c.where("clip_id % 4 <> 1").select(stem.alias("stem"), body).union(c.where("clip_id % 9 = 0").select(F.concat(stem, F.lit("-track")).alias("stem"), body))
    for rows, name in ((media, "media"), (c.where("clip_id % 3 <> 2").select(stem.alias("stem"), body), "sidecars")):
        rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "stem").write.partitionBy("stem").text(f"{path}/{name}")
    # batches hold names only, no contents
    media, sidecars = (finished.arrivals(spark, f"{path}/{name}", "part-*", 10_000) for name in ("media", "sidecars"))
    finished.complete(media, sidecars).select("stem").writeStream.format("parquet").option("path", f"{path}/complete").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("stem string").parquet(f"{path}/complete")


@query("s23_track_label_export", "v_tags", "v_tracks", "v_regions", sql="""l as (select track_id, min(what) as label from v_tags group by 1), f as (select track_id, string_agg(frame_number, ',' order by frame_number) as frames from v_regions where ffc group by 1)
select label, '{"clip_id":'||clip_id||',"track_id":'||v.track_id||',"start_frame":'||start_frame||',"end_frame":'||end_frame||',"label":"'||label||'","ffc_frames":['||coalesce(frames, '')||']}' as value from v_tracks v join l on l.track_id=v.track_id left join f on f.track_id=v.track_id""")
def s23(t, v, regions):
    label = t.groupBy("track_id").agg(F.min("what").alias("label"))
    ffc = regions.where("ffc").groupBy("track_id").agg(F.array_sort(F.collect_list("frame_number")).alias("ffc_frames"))
    full = v.join(label, "track_id").join(ffc, "track_id", "left").withColumn("ffc_frames", F.coalesce("ffc_frames", F.array().cast("array<long>")))
    return full.select("label", F.to_json(F.struct("clip_id", "track_id", "start_frame", "end_frame", "label", "ffc_frames")).alias("value"))


@query("s24_read_manifest", "v_samples", sql="select label, count(*) as n from v_samples where label<>'5-LOW' group by label")
def s24(v):
    counts = v.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    text = counts.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("counts"), F.array(F.lit("5-LOW")).alias("excluded"))).alias("value"))
    m = text.select(F.from_json("value", "struct<counts:map<string,long>,excluded:array<string>>").alias("m"))
    return m.select(F.col("m.excluded").alias("x"), F.explode("m.counts").alias("label", "n")).where(~F.array_contains("x", F.col("label"))).select("label", "n")


@query("s25_read_shards", "v_samples", sql="m(label, idx) as (values ('1-URGENT',0),('2-HIGH',0),('3-MEDIUM',1)) select sample_id, idx, mass from v_samples join m using (label) where mass>=10")
def s25(v):
    """Shards are written, and read back with their labels renumbered."""
    path = d.shared_folder(v.sparkSession, "shards")
    d.write_shards(split(v), path, 8)
    return d.read_shards(v.sparkSession, path, {"1-URGENT": 0, "2-HIGH": 0, "3-MEDIUM": 1}, 10).select("sample_id", "idx", "mass")


@query("x16_content_key", "embeddings", sql="select vec_id, sha256(array_to_string(list_transform(embedding, lambda x: cast(floor(cast(x as double)*1e6+5e-1) as bigint)), ',')) as key from embeddings")
def x16(e):
    """A key of the content, from values to six decimals: equal inputs, equal keys on any engine."""
    fixed = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1e6 + 0.5).cast("string"))
    return e.select("vec_id", F.sha2(F.array_join(fixed, ",").cast("binary"), 256).alias("key"))


@query("x18_json_values", "v_regions", sql="""select track_id, frame_number, '{"x":'||x||',"y":'||y||',"width":'||width||',"height":'||height||',"mass":'||mass||',"blank":'||blank||',"pixel_variance":'||floor(pixel_variance*1e2+5e-1)/1e2||'}' as json from v_regions""")
def x18(v):
    return v.select("track_id", "frame_number", F.to_json(F.struct("x", "y", "width", "height", "mass", "blank", (F.floor(F.col("pixel_variance") * 100.0 + 0.5) / 100.0).alias("pixel_variance"))).alias("json"))


