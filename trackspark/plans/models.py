"""m01-m07, p11, t03, t09-t11, t16: models, and what streams hand to them."""

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from trackspark.operators import models as m
from trackspark.operators import predictions as p
from trackspark.operators import samples as s
from trackspark.operators import follower, recorder, tracker
from trackspark.sources import documents as d
from trackspark.streaming import finished

from .base import query, r6
from .samples import usable
from .streams import detections, order


def vectors(e):
    return e.select("vec_id", (F.col("vec_id") % 50).alias("track_id"), "label", "embedding")


@query("m01_scorer", "embeddings")
def m01(e):
    return m.scored(vectors(e), m.fit_centroids(vectors(e).where("vec_id % 4 <> 0")), ["vec_id"])


def framed(v):
    """The frames of a clip as those of a track; the box leaves a border of one pixel out."""
    return v.select(F.col("clip_id").alias("track_id"), "frame_number", "y", "x", "v", F.expr("x between 1 and 6 and y between 1 and 6").alias("inside"))


def clip_model(v):
    """A model of the clips' looks, from every fourth frame, stored in a folder and loaded from it."""
    path = d.shared_folder(v.sparkSession, "model")
    found = m.patches(framed(v)).where("frame_number % 4 = 0")
    mean = m.fit_centroids(found.select(F.col("track_id").alias("label"), F.flatten(F.array_repeat("patch", 4)).alias("embedding")))
    model = m.Model([f"clip-{x}" for x in mean.labels], "centroid", {"means": mean.means}, {f"clip-{x}": 0.105 for x in mean.labels}, {"square_width": 2, "seed": 3})
    m.save_model(v.sparkSession, path, model)
    return m.load_model(v.sparkSession, path)


@query("m03_classify_tracks", "v_pixels")
def m03_tracks(v):
    """Tracks scored end to end: patches, samples, a stored model, samples combined by mass."""
    return m.classify_tracks(m.patches(framed(v)).where("frame_number % 4 <> 0"), clip_model(v)).select("track_id", "label", r6("score").alias("score"), r6("clarity").alias("clarity"), "tag", "samples", "version")


@query("m02_samples_for_scoring", "v_regions", sql="""u as (select track_id, frame_number from v_regions where not blank and not ffc and mass>0), l as (select * from (select *, row_number() over (partition by track_id order by frame_number desc) as back from u) where back<=30),
r as (select *, row_number() over (partition by track_id order by md5(concat_ws('|','m02',track_id,frame_number)), track_id, frame_number) as rn from l) select track_id, frame_number from r where rn<=8""")
def m02(v):
    last = usable(v).withColumn("back", F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("frame_number")))).where("back <= 30")
    return s.ranked(last, ["track_id"], "m02", "track_id", "frame_number").where("rn <= 8").select("track_id", "frame_number")


def track_labels(e):
    """Tracks scored end to end: score each sample, then combine by mass."""
    model = m.fit_centroids(vectors(e).where("vec_id % 4 <> 0"))
    long = m.scored(vectors(e), model, ["vec_id", "track_id"]).select("vec_id", "track_id", (1 + F.col("vec_id") % 97).alias("mass"), F.posexplode("scores").alias("idx", "score"))
    return p.best(p.track_scores(long))


@query("m03_score_tracks", "embeddings")
def m03(e):
    return track_labels(e).select("track_id", "label_1", r6("score_1").alias("score"))


@query("m04_bulk_scoring", "embeddings")
def m04(e):
    model = m.fit_centroids(vectors(e))
    out = m.scored(vectors(e), model, ["vec_id", "label"])
    best = F.array_position("scores", F.array_max("scores")) - 1
    return out.withColumn("pred", best).groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))


def features(e):
    return e.select("vec_id", "label", F.col("embedding").alias("features"))


@query("m05_forest_scores", "embeddings")
def m05(e):
    return m.forest_scores(m.forest(features(e).where("vec_id % 4 <> 0")), features(e), "vec_id")


@query("m06_forest_training", "embeddings")
def m06(e):
    model = m.forest(features(e))
    return m.forest_scores(model, features(e), "vec_id", "label").groupBy("label").agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"))


@query("m07_parameter_search", "embeddings")
def m07(e):
    return m.grid_search(features(e), [5, 10], [3, 5])


@query("m07_axis_search", "embeddings")
def m07_axis(e):
    return m.axis_search(features(e), {"trees": [5, 20], "depth": [3, 7]}, d.shared_folder(e.sparkSession, "search"))


def pictures(v):
    """Frames as arrays, row by row; a clip is a camera, and a second a frame."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", F.floor("v").cast("double").alias("v"))))
    one = v.groupBy(F.col("clip_id").alias("camera"), "frame_number").agg(cells["v"].alias("pixels"))
    return one.withColumn("ts", F.timestamp_seconds("frame_number"))


@query("t03_camera_background", "v_pixels", sql="""w as (select clip_id, y, x, list(floor(v) order by frame_number) as f from v_pixels where y between 1 and 6 and x between 1 and 6 group by 1,2,3),
r(clip_id, y, x, f, i, bg, w) as (select clip_id, y, x, f, 1::bigint, f[1], 0e0 from w union all select clip_id, y, x, f, i+1, case when bg<f[i+1]-w then bg else f[i+1] end, case when bg<f[i+1]-w then w+5e0 else 0e0 end from r where i<len(f))
select a.clip_id as camera, py as y, px as x, r.bg as background from (select distinct clip_id from v_pixels) a, range(0, 8) u(py), range(0, 8) t(px) join r on r.clip_id=a.clip_id and r.y=least(6, greatest(1, py)) and r.x=least(6, greatest(1, px)) and r.i=len(r.f)""")
def t03(v):
    """Each camera's background after its last frame, pixel by pixel; the edges are copies."""
    last = recorder.backgrounds(pictures(v), 8, 1, 5.0, last_only=True)
    cells = last.select("camera", F.posexplode("background").alias("at", "background"))
    return cells.select("camera", F.floor(F.col("at") / 8).alias("y"), (F.col("at") % 8).cast("long").alias("x"), "background")


@query("t09_motion_prediction", "v_regions")
def t09(v):
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame_number")
        motion, out = None, []
        for f, x, y in rows[["frame_number", "cx", "cy"]].itertuples(index=False):
            motion = motion or tracker.Motion(x, y)
            motion.correct(x, y)
            out.append((int(rows["track_id"].iloc[0]), int(f), *motion.predict()))
        return pd.DataFrame(out, columns=["track_id", "frame_number", "px", "py"])

    mid = v.where("not blank").select("track_id", "frame_number", (F.col("x") + F.col("width") / 2).alias("cx"), (F.col("y") + F.col("height") / 2).alias("cy"))
    return mid.groupBy("track_id").applyInPandas(one, "track_id long, frame_number long, px double, py double")


@query("t10_classification_cadence", "v_stream", sql="n as (select camera, event_id, row_number() over (partition by camera order by ts, event_id) as n from v_stream) select event_id, case when n%25=0 then 'full' when n%10=0 then 'cheap' end as model from n where n%25=0 or n%10=0")
def t10(st):
    n = st.withColumn("n", F.row_number().over(order()))
    return n.where("n % 25 = 0 or n % 10 = 0").select("event_id", F.when(F.col("n") % 25 == 0, "full").otherwise("cheap").alias("model"))


#: The last label stands for nothing.
CADENCE = follower.Cadence(false_positive=2)


def offered(v):
    """Regions as rows of a clip, and what the models would say of each: false-positive in so many hundredths, else one of two animals."""
    share = (F.col("mass") % 100) / 100.0
    other = F.when(F.col("track_id") % 2 == 0, F.array(1 - share, F.lit(0.0), share)).otherwise(F.array(F.lit(0.0), 1 - share, share))
    return follower.regions_as_rows(v, other)


@query("t10_track_cadence", "v_regions")
def t10_tracks(v):
    """Which model is asked about which track, frame by frame, when answers come at once."""
    return follower.followed(offered(v), CADENCE).where("event = 'request'").select(F.col("camera").alias("clip_id"), "frame_number", "track_id", "model")


@query("t11_track_events", "v_regions")
def t11(v):
    """What subscribers hear of each online track: starts, frames with scores and last prediction, ends, and tracks that are dropped."""
    steps = tracker.assign(detections(v)).withColumnRenamed("online_track", "track_id")
    told = follower.followed(offered(steps), CADENCE).where("event <> 'request'")
    return told.select(F.col("camera").alias("clip_id"), "frame_number", "track_id", "event", "label", r6("confidence").alias("confidence"), "x", "y", "width", "height", "mass", "blank", "last_prediction")


@query("t16_reprocessed_tracks", "v_pixels")
def t16(v):
    """Recordings and sidecars as files in a folder, paired by a stream, scored again with all frames, told as final."""
    spark, path = v.sparkSession, d.shared_folder(v.sparkSession, "finished")
    lines = v.groupBy("clip_id", "frame_number").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v")))["v"].alias("pixels"))
    line = F.to_json(F.struct(F.col("clip_id").alias("track_id"), "frame_number", F.lit(8).alias("width"), "pixels", F.lit(1).alias("border")))
    stem = F.concat(F.lit("r"), "clip_id")
    lines.select(stem.alias("stem"), line.alias("value")).repartition("stem").write.partitionBy("stem").text(f"{path}/media")
    v.select(stem.alias("stem"), F.to_json(F.struct(F.col("clip_id").alias("id"))).alias("value")).distinct().repartition("stem").write.partitionBy("stem").text(f"{path}/sidecars")
    whole = finished.complete(finished.arrivals(spark, f"{path}/media", "part-*"), finished.arrivals(spark, f"{path}/sidecars", "part-*"))
    finished.reprocess(whole, clip_model(v), f"{path}/events", f"{path}/checkpoint").awaitTermination()
    return finished.events(spark, f"{path}/events").select("stem", "track_id", "label", r6("score").alias("score"), "final")
