"""a23-a33, j11, j12, j14, k06, k08-k11: predictions of tracks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackspark.operators import predictions as p

from .base import query, r6

SMOOTH = """ms as (select track_id, sum(mass) as m from (select distinct track_id, vec_id, mass from v_predictions) group by track_id),
t as (select x.track_id, idx, sum(score*mass)/max(m) as score from v_predictions x join ms on ms.track_id=x.track_id group by x.track_id, idx),
rk as (select *, row_number() over (partition by track_id order by round(score, 9) desc, idx) as place from t),
b as (select track_id, max(idx) filter (where place=1) as label_1, max(idx) filter (where place=2) as label_2, max(idx) filter (where place=3) as label_3, max(score) filter (where place=1) as score_1, max(score) filter (where place=2) as score_2, max(score) filter (where place=3) as score_3 from rk group by track_id)
"""
NAMES = [f"animal{i}" for i in range(10)]


@query("a23_track_scores", "v_predictions", sql=SMOOTH + ", q as (select track_id, idx, sum(score) as s from v_predictions group by 1,2) select t.track_id, t.idx, round(t.score, 6) as smoothed, round(q.s/sum(q.s) over (partition by q.track_id), 6) as plain from t join q on t.track_id=q.track_id and t.idx=q.idx")
def a23(v):
    plain = p.track_scores(v, smooth=False).withColumnRenamed("score", "plain")
    return p.track_scores(v).join(plain, ["track_id", "idx"]).select("track_id", "idx", r6("score").alias("smoothed"), r6("plain").alias("plain"))


@query("a24_incremental_scores", "v_predictions", sql="select track_id, idx, round(sum(score*score*mass), 6) as score, max(seq) as last_seq, count(*) as n from v_predictions group by track_id, idx")
def a24(v):
    return v.groupBy("track_id", "idx").agg(r6(F.sum(F.col("score") * F.col("score") * F.col("mass"))).alias("score"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n"))


@query("a25_single_frames", "v_predictions", sql="select track_id, idx, round(arg_max(score, seq), 6) as last_score, round(sum(score*score*mass), 6) as smoothed from v_predictions group by track_id, idx")
def a25(v):
    return v.groupBy("track_id", "idx").agg(r6(F.max_by("score", "seq")).alias("last_score"), r6(F.sum(F.col("score") * F.col("score") * F.col("mass"))).alias("smoothed"))


@query("a26_normalised", "v_predictions", sql="t as (select track_id, idx, sum(score*score*mass) as s from v_predictions group by 1,2) select track_id, idx, round(s/sum(s) over (partition by track_id), 6) as score from t")
def a26(v):
    return p.normalised(p.running_scores(v)).select("track_id", "idx", r6("score").alias("score"))


@query("a27_short_evidence_cap", "v_predictions", sql=SMOOTH + ", f as (select * from b where track_id%4=0 and label_1<>3) select t.track_id, t.idx, round(t.score*case when f.track_id is not null and sum(t.score) over (partition by t.track_id)>5e-1 then 5e-1/sum(t.score) over (partition by t.track_id) else 1 end, 6) as score from t left join f on f.track_id=t.track_id")
def a27(v):
    scores = p.track_scores(v)
    few = p.best(scores).where("track_id % 4 = 0 and label_1 <> 3")
    return p.capped(scores, few).select("track_id", "idx", r6("score").alias("score"))


@query("a28_best_labels", "v_predictions", sql=SMOOTH + """, d as (select *, 'animal'||label_1||' '||printf('%.1f', score_1*10)||' (clarity '||printf('%.1f', (score_1-score_2)*10)||')' as f from b)
select track_id, label_1, label_2, label_3, round(score_1, 6) as score_1, round(score_1-score_2, 6) as clarity, case when score_1>5e-1 then f else '[nothing] '||f end||case when score_2>5e-1 then ' [second guess - animal'||label_2||' '||printf('%.1f', score_2*10)||']' else '' end as text from d""")
def a28(v):
    b = p.best(p.track_scores(v))
    c = F.col
    text = p.description(F.array(*map(F.lit, NAMES)), c("label_1"), c("score_1"), c("clarity"), c("label_2"), c("score_2"))
    return b.select("track_id", "label_1", "label_2", "label_3", r6("score_1").alias("score_1"), r6("clarity").alias("clarity"), text.alias("text"))


@query("a29_score_at_time", "v_predictions", sql="""c as (select track_id, idx, seq, sum(score*mass) over (partition by track_id, idx order by seq rows between unbounded preceding and current row) as s from v_predictions),
n as (select *, s/sum(s) over (partition by track_id, seq) as q from c), r as (select *, row_number() over (partition by track_id, seq order by round(q, 9) desc, idx) as place from n) select track_id, seq, idx as label, round(q, 6) as score from r where place=1""")
def a29(v):
    running = F.sum(F.col("score") * F.col("mass")).over(Window.partitionBy("track_id", "idx").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    at = Window.partitionBy("track_id", "seq")
    share = v.withColumn("s", running).withColumn("q", F.col("s") / F.sum("s").over(at))
    top = share.withColumn("place", F.row_number().over(at.orderBy(F.desc(F.round("q", 9)), "idx"))).where("place = 1")
    return top.select("track_id", "seq", F.col("idx").alias("label"), r6("q").alias("score"))


@query("a30_result_metadata", "v_predictions", sql=SMOOTH + ", th as (select b.*, case label_1 when 1 then 12e-2 when 4 then 2e-1 else 8e-1 end as threshold from b) select track_id, label_1 as tag, threshold, score_1>=threshold as confident, round_even(score_1, 2) as confidence, round_even(score_1-score_2, 3) as clarity from th")
def a30(v):
    limits = v.sparkSession.createDataFrame([(1, 0.12), (4, 0.2)], "label_1 long, threshold double")
    b = p.best(p.track_scores(v)).join(F.broadcast(limits), "label_1", "left").fillna(0.8, ["threshold"])
    return b.select("track_id", F.col("label_1").alias("tag"), "threshold", (F.col("score_1") >= F.col("threshold")).alias("confident"), F.bround("score_1", 2).alias("confidence"), F.bround("clarity", 3).alias("clarity"))


@query("a31_mean_vote", "v_predictions", sql="m as (select track_id, idx, avg(score) as s from v_predictions group by 1,2) select track_id, idx as label, round(s, 6) as score from (select *, row_number() over (partition by track_id order by round(s, 9) desc, idx) as r from m) where r=1")
def a31(v):
    m = v.groupBy("track_id", "idx").agg(F.avg("score").alias("score"))
    return p.ranked(m).where("place = 1").select("track_id", F.col("idx").alias("label"), r6("score").alias("score"))


@query("a32_beacon_maxima", "v_predictions", sql=SMOOTH + " select case idx when 0 then 5 when 1 then 5 when 2 then 7 else idx end as beacon_idx, round(max(score), 6) as score from t group by 1")
def a32(v):
    remap = v.sparkSession.createDataFrame([(0, 5), (1, 5), (2, 7)], "idx long, to long")
    t = p.track_scores(v).join(F.broadcast(remap), "idx", "left")
    return t.groupBy(F.coalesce("to", "idx").alias("beacon_idx")).agg(r6(F.max("score")).alias("score"))


@query("a33_best_model", "v_predictions", "v_tracks", sql="""mn as (select track_id, count(distinct vec_id) as n from v_predictions where track_id%3<>0 group by 1), fp as (select track_id, count(distinct vec_id) as n from v_predictions where track_id%2=0 group by 1)
select v.track_id, case when mn.n>0 then 'main' when fp.n>0 then 'fp' end as model, coalesce(mn.n, fp.n) as n from v_tracks v left join mn using (track_id) left join fp using (track_id)""")
def a33(v, tracks):
    n = lambda rows, name: rows.groupBy("track_id").agg(F.countDistinct("vec_id").alias(name))
    both = tracks.join(n(v.where("track_id % 3 <> 0"), "m"), "track_id", "left").join(n(v.where("track_id % 2 = 0"), "f"), "track_id", "left")
    return both.select("track_id", F.when(F.col("m") > 0, "main").when(F.col("f") > 0, "fp").alias("model"), F.coalesce("m", "f").alias("n"))


@query("j11_attach_predictions", "v_predictions", "v_tracks", sql="t as (select track_id, seq%2 as model_id, count(distinct vec_id) as n, max(seq) as last_seq from v_predictions group by 1,2) select v.track_id, array_to_string(list_sort(list(model_id||':'||n||':'||last_seq) filter (where model_id is not null)), ',') as models from v_tracks v left join t using (track_id) group by v.track_id")
def j11(v, tracks):
    t = v.groupBy("track_id", (F.col("seq") % 2).alias("model_id")).agg(F.countDistinct("vec_id").alias("n"), F.max("seq").alias("last_seq"))
    listed = tracks.join(t, "track_id", "left").groupBy("track_id").agg(F.array_sort(F.collect_list(F.when(F.col("model_id").isNotNull(), F.concat_ws(":", "model_id", "n", "last_seq")))).alias("m"))
    return listed.select("track_id", F.when(F.size("m") > 0, F.array_join("m", ",")).alias("models"))


@query("j12_reuse_frames", "v_predictions", "v_tracks", sql="o as (select track_id, list_sort(list(distinct seq)) as f from v_predictions where seq<4 group by track_id) select v.track_id, coalesce(array_to_string(f, ','), 'new') as frames from v_tracks v left join o using (track_id)")
def j12(v, tracks):
    o = v.where("seq < 4").groupBy("track_id").agg(F.array_join(F.array_sort(F.collect_set("seq")).cast("array<string>"), ",").alias("f"))
    return tracks.join(o, "track_id", "left").select("track_id", F.coalesce("f", F.lit("new")).alias("frames"))


@query("j14_merge_model_output", "v_predictions", "v_tracks", sql="b as (select track_id, arg_max(idx, round(score,9)*1000-idx/1e3) as idx from v_predictions where seq=0 group by 1) select v.clip_id, v.track_id, b.idx as fp_label, b.idx is not null as scored from v_tracks v left join b using (track_id)")
def j14(v, tracks):
    b = v.where("seq = 0").groupBy("track_id").agg(F.max_by("idx", F.round("score", 9) * 1000 - F.col("idx") / 1e3).alias("idx"))
    return tracks.join(b, "track_id", "left").select("clip_id", "track_id", F.col("idx").alias("fp_label"), F.col("idx").isNotNull().alias("scored"))


THUMBNAILS = """s as (select *, 1+(frame_number*7)%30 as contours, (frame_number*13)%40-5 as diff, (frame_number%5)/2e0 as off, x<=1 or y<=1 or y+height>=119 or x+width>=159 as border from v_regions where not blank and mass>0),
m as (select *, max(mass) over w as mm, max(contours) over w as mc, max(diff) over w as md from s window w as (partition by track_id)),
z as (select track_id, frame_number, mass/cast(mm as double)*40+contours/cast(mc as double)*50+case when md=0 then 0 else diff/cast(md as double)*40 end-2*off-case when border then 1000 else 0 end as score from m),
thumb as (select track_id, frame_number, round(score, 6) as score from (select *, row_number() over (partition by track_id order by round(score, 6) desc, frame_number) as r from z) where r=1)
"""


@query("k06_best_thumbnail", "v_regions", sql=THUMBNAILS + "select * from thumb")
def k06(v):
    f = F.col("frame_number")
    border = (F.col("x") <= 1) | (F.col("y") <= 1) | (F.col("y") + F.col("height") >= 119) | (F.col("x") + F.col("width") >= 159)
    s = v.where("not blank and mass > 0").select("track_id", "frame_number", "mass", (1 + (f * 7) % 30).alias("contours"), ((f * 13) % 40 - 5).alias("diff"), ((f % 5) / 2.0).alias("off"), border.alias("border"))
    share = lambda c: F.col(c) / F.max(c).over(p.by_track())
    score = share("mass") * 40 + share("contours") * 50 + F.when(F.max("diff").over(p.by_track()) == 0, 0.0).otherwise(share("diff") * 40) - 2 * F.col("off") - F.when(F.col("border"), 1000).otherwise(0)
    rank = F.row_number().over(p.by_track().orderBy(F.desc("score"), "frame_number"))
    return s.withColumn("score", r6(score)).withColumn("r", rank).where("r = 1").select("track_id", "frame_number", "score")


@query("k08_live_thumbnail", "v_regions", sql="s as (select track_id, frame_number, case when frame_number%3=0 then 0 else 1000 end+case when mass>80 then mass else 1+(frame_number*7)%30 end as score from v_regions where not blank) select track_id, frame_number, score from (select *, row_number() over (partition by track_id order by score desc, frame_number) as r from s) where r=1")
def k08(v):
    f, mass = F.col("frame_number"), F.col("mass")
    score = F.when(f % 3 == 0, 0).otherwise(1000) + F.when(mass > 80, mass).otherwise(1 + (f * 7) % 30)
    s = v.where("not blank").withColumn("score", score)
    return s.withColumn("r", F.row_number().over(p.by_track().orderBy(F.desc("score"), "frame_number"))).where("r = 1").select("track_id", "frame_number", "score")


CANDIDATES = SMOOTH + """, c as (select b.track_id, track_id%5 as camera, label_1, score_1/(select sum(score) from t where t.track_id=b.track_id) as conf, (select score from t where t.track_id=b.track_id and idx=3)/(select sum(score) from t where t.track_id=b.track_id) as fp,
 (track_id*7)%60 as since, track_id%4 as n_preds from b), e as (select *, label_1=3 and conf>=12e-2 as is_fp, since>=case when n_preds<2 then 20 else 40 end as due from c),
ok as (select *, row_number() over (partition by camera order by round(1-fp, 9) desc, track_id) as r from e where not is_fp and due), fb as (select *, row_number() over (partition by camera order by round(conf, 9), track_id) as r from e where is_fp)
"""


@query("k09_next_tracks", "v_predictions", sql=CANDIDATES + "select camera, track_id from ok where r=1 union all select camera, track_id from fb where r=1 and camera not in (select camera from ok)")
def k09(v):
    scores = p.normalised(p.track_scores(v))
    fp = scores.where("idx = 3").select("track_id", F.col("score").alias("fp"))
    c = p.best(scores).join(fp, "track_id").withColumn("camera", F.col("track_id") % 5)
    c = c.withColumn("is_fp", (F.col("label_1") == 3) & (F.col("score_1") >= 0.12)).withColumn("due", (F.col("track_id") * 7) % 60 >= F.when(F.col("track_id") % 4 < 2, 20).otherwise(40))
    camera = Window.partitionBy("camera")
    ok = c.where("not is_fp and due").withColumn("r", F.row_number().over(camera.orderBy(F.desc(F.round(1 - F.col("fp"), 9)), "track_id"))).where("r = 1")
    least = c.where("is_fp").withColumn("r", F.row_number().over(camera.orderBy(F.round("score_1", 9), "track_id"))).where("r = 1")
    return ok.select("camera", "track_id").union(least.join(ok, "camera", "left_anti").select("camera", "track_id"))


@query("k10_priority", "v_predictions", sql=SMOOTH + " select track_id, round(case when track_id%9=0 then 100 else ((track_id*7)%60)/9e0+case when track_id%4=0 then 2 else 0 end-case when label_1=3 then 100 else 0 end end, 6) as priority from b")
def k10(v):
    t = F.col("track_id")
    waiting = ((t * 7) % 60) / 9.0 + F.when(t % 4 == 0, 2).otherwise(0) - F.when(F.col("label_1") == 3, 100).otherwise(0)
    return p.best(p.track_scores(v)).select("track_id", r6(F.when(t % 9 == 0, 100.0).otherwise(waiting)).alias("priority"))


@query("k11_last_regions", "v_regions", sql="r as (select *, sum(case when blank then 0 else 1 end) over (partition by track_id order by frame_number desc rows between unbounded preceding and current row) as k from v_regions) select track_id, frame_number from r where k<=5 and not blank")
def k11(v):
    back = Window.partitionBy("track_id").orderBy(F.desc("frame_number")).rowsBetween(Window.unboundedPreceding, 0)
    return v.withColumn("k", F.sum((~F.col("blank")).cast("long")).over(back)).where("k <= 5 and not blank").select("track_id", "frame_number")
