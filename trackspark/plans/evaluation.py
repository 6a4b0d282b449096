"""a34-a46, j10, u03: evaluation."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackspark.operators import evaluation as ev

from .base import query, r6

BEST = """rk as (select vec_id, track_id, true_idx, idx, score, row_number() over (partition by vec_id order by round(score, 9) desc, idx) as place from v_predictions),
res as (select vec_id, track_id, true_idx as truth, idx as pred, score as conf from rk where place=1)
"""
GRID = "grid as (select a.i as truth, b.i as pred from range(10) a(i), range(10) b(i))\n"
NAME = "case {} when 0 then 'bird' when 1 then 'vehicle' when 2 then 'mustelid' when 3 then 'false-positive' when 4 then 'None' else 'l'||{} end"


def results(v):
    top = v.withColumn("place", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc(F.round("score", 9)), "idx"))).where("place = 1")
    return top.select("vec_id", "track_id", F.col("true_idx").alias("truth"), F.col("idx").alias("pred"), F.col("score").alias("conf"))


def named(c):
    i = F.col(c)
    return F.when(i == 0, "bird").when(i == 1, "vehicle").when(i == 2, "mustelid").when(i == 3, "false-positive").when(i == 4, "None").otherwise(F.concat(F.lit("l"), i.cast("string")))


@query("a34_confusion", "v_predictions", sql=BEST + "," + GRID + "select g.truth, g.pred, count(vec_id) as n from grid g left join res r on g.truth=r.truth and g.pred=r.pred group by g.truth, g.pred")
def a34(v):
    return ev.confusion(results(v), list(map(str, range(10))))


@query("a35_row_percentages", "v_predictions", sql=BEST + "," + GRID + ", c as (select g.truth, g.pred, count(vec_id) as n from grid g left join res r on g.truth=r.truth and g.pred=r.pred group by g.truth, g.pred) select truth, pred, case when sum(n) over w=0 then 0e0 else round_even(n/cast(sum(n) over w as double), 2) end as share from c window w as (partition by truth)")
def a35(v):
    c = ev.confusion(results(v), list(map(str, range(10))))
    return c.select("truth", "pred", ev.row_share(c).alias("share"))


@query("a36_multi_label_confusion", "v_predictions", sql="""h as (select vec_id, true_idx as truth, idx as pred from v_predictions where score>=2e-1), n as (select distinct vec_id, true_idx as truth, -1::bigint as pred from v_predictions where vec_id not in (select vec_id from h))
select truth, pred, count(*) as n from (select * from h union all select * from n) group by 1,2""")
def a36(v):
    h = v.where("score >= 0.2").select("vec_id", F.col("true_idx").alias("truth"), F.col("idx").alias("pred"))
    nothing = v.select("vec_id", F.col("true_idx").alias("truth")).distinct().join(h, "vec_id", "left_anti").withColumn("pred", F.lit(-1).cast("long"))
    return h.union(nothing).groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))


@query("a37_model_score", "v_predictions", sql=BEST + f""", c as (select {NAME.format('truth','truth')} as truth, {NAME.format('pred','pred')} as pred, count(*) as n from res group by 1,2),
s as (select truth, pred, round_even(n/cast(sum(n) over (partition by truth) as double), 2) as share from c),
per as (select truth, sum(case when truth=pred then share else 0 end) as acc, sum(case when pred in ('false-positive','None','unidentified') then share else 0 end) as unsure from s group by truth)
select round(sum(acc*case truth when 'bird' then 12e-1 when 'vehicle' then 8e-1 when 'wallaby' then 8e-1 when 'mustelid' then 9e-1 when 'human' then 9e-1 when 'None' then 0e0 else 1e0 end-case when truth='bird' then 1-unsure-acc else 0 end), 6) as score from per""")
def a37(v):
    cells = results(v).groupBy(named("truth").alias("truth"), named("pred").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return ev.model_score(cells, F.col("truth"))


@query("a38_threshold_sweep", "v_predictions", sql=BEST + ", t as (select i/2e1 as threshold from range(2, 10) r(i)) select threshold, truth, case when conf<threshold then -1 else pred end as pred, count(*) as n from res, t group by 1,2,3")
def a38(v):
    steps = F.explode(F.transform(F.sequence(F.lit(2), F.lit(9)), lambda i: i / 20.0))
    swept = results(v).withColumn("threshold", steps).withColumn("pred", F.when(F.col("conf") < F.col("threshold"), F.lit(-1).cast("long")).otherwise(F.col("pred")))
    return swept.groupBy("threshold", "truth", "pred").agg(F.count(F.lit(1)).alias("n"))


CURVE = """s as (select idx as label, round(score, 3) as score, sum(case when true_idx=idx then 1 else 0 end) as h, count(*) as n from v_predictions group by 1,2),
c as (select label, score, sum(h) over w as tp, sum(n) over w as k, sum(h) over (partition by label) as a from s window w as (partition by label order by score desc rows between unbounded preceding and current row)),
f as (select label, score, case when a=0 or tp=0 then 0e0 else 2*(tp/cast(k as double))*(tp/cast(a as double))/((tp/cast(k as double))+(tp/cast(a as double))) end as f1 from c)
"""
BEST_THRESHOLD = "select label, score as threshold, round(f1, 6) as f1 from (select *, row_number() over (partition by label order by round(f1, 9) desc, score) as r from f) where r=1"


@query("a40_best_threshold", "v_predictions", sql=CURVE + BEST_THRESHOLD)
def a40(v):
    scored = v.select(F.col("idx").alias("label"), F.round("score", 3).alias("score"), (F.col("true_idx") == F.col("idx")).cast("int").alias("hit"))
    c = ev.curve(scored)
    r = F.row_number().over(Window.partitionBy("label").orderBy(F.desc(F.round("f1", 9)), "threshold"))
    return c.withColumn("r", r).where("r = 1").select("label", "threshold", r6("f1").alias("f1"))


@query("a39_label_thresholds", "v_predictions", sql=BEST + "," + CURVE.rstrip() + ",\nt as (" + BEST_THRESHOLD + "), c9 as (select label as pred, round(least(9e-1, greatest(5e-1, threshold)), 3) as th from t) select truth, case when conf<th then -1 else res.pred end as pred, count(*) as n from res join c9 on c9.pred=res.pred group by 1,2")
def a39(v):
    """Predictions under the best threshold of their label, kept within 0.5 and 0.9, are none."""
    th = a40(v).select(F.col("label").alias("pred"), F.round(F.least(F.lit(0.9), F.greatest(F.lit(0.5), F.col("threshold"))), 3).alias("th"))
    rows = results(v).join(F.broadcast(th), "pred")  # one row per label
    return rows.groupBy("truth", F.when(F.col("conf") < F.col("th"), F.lit(-1).cast("long")).otherwise(F.col("pred")).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


@query("a41_accuracy_by_size", "v_predictions", "v_regions", sql=BEST + """, ar as (select track_id, quantile_cont(width*height, 5e-1) as a from v_regions group by track_id),
b as (select res.*, least(40, greatest(4, cast(ceil(sqrt(a)) as bigint))) as bucket from res join ar on ar.track_id=res.track_id)
select bucket, truth, count(*) filter (where conf>=15e-2 and pred=truth) as correct, count(*) filter (where conf>=15e-2 and pred<>truth) as incorrect, count(*) filter (where conf<15e-2) as unidentified, count(*) as n from b group by grouping sets ((bucket), (bucket, truth))""")
def a41(v, regions):
    area = regions.groupBy("track_id").agg(F.percentile(F.col("width") * F.col("height"), F.lit(0.5)).alias("a"))
    b = results(v).join(area, "track_id").withColumn("bucket", F.least(F.lit(40), F.greatest(F.lit(4), F.ceil(F.sqrt("a")))).cast("long"))
    n = lambda c: F.count(F.when(c, 1))
    sure = F.col("conf") >= 0.15
    return b.groupingSets([["bucket"], ["bucket", "truth"]], "bucket", "truth").agg(n(sure & (F.col("pred") == F.col("truth"))).alias("correct"), n(sure & (F.col("pred") != F.col("truth"))).alias("incorrect"), n(~sure).alias("unidentified"), F.count(F.lit(1)).alias("n"))


@query("a42_outcome_lists", "v_predictions", sql=BEST + ", o as (select track_id, case when conf<15e-2 then 'low' when pred=truth then 'correct' else 'incorrect' end as outcome, vec_id from res) select track_id, outcome, array_to_string(list_sort(list(vec_id)), ',') as vecs from o group by 1,2")
def a42(v):
    o = F.when(F.col("conf") < 0.15, "low").when(F.col("pred") == F.col("truth"), "correct").otherwise("incorrect")
    return results(v).groupBy("track_id", o.alias("outcome")).agg(F.array_join(F.array_sort(F.collect_list("vec_id")).cast("array<string>"), ",").alias("vecs"))


@query("a43_stored_tag_confusion", "v_tags", sql="""m as (select *, case when what='rat' then 'rodent' else what end as w from v_tags), h as (select track_id, arg_max(w, confidence*1e6-tag_id/1e6) as truth from m where not automatic group by 1), a as (select track_id, arg_max(w, confidence*1e6-tag_id/1e6) as pred from m where automatic group by 1)
select truth, coalesce(pred, 'None') as pred, count(*) as n from h left join a using (track_id) group by 1,2""")
def a43(g):
    m = g.withColumn("w", F.when(F.col("what") == "rat", "rodent").otherwise(F.col("what")))
    best = lambda rows, name: rows.groupBy("track_id").agg(F.max_by("w", F.col("confidence") * 1e6 - F.col("tag_id") / 1e6).alias(name))
    both = best(m.where("not automatic"), "truth").join(best(m.where("automatic"), "pred"), "track_id", "left")
    return both.groupBy("truth", F.coalesce("pred", F.lit("None")).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


@query("a44_label_f1", "v_predictions", sql=BEST + ", l as (select i as label from range(10) r(i)) select label, round(coalesce(2e0*count(*) filter (where truth=label and pred=label)/nullif(count(*) filter (where truth=label)+count(*) filter (where pred=label), 0), 0), 6) as f1 from l left join res on truth=label or pred=label group by label")
def a44(v):
    sides = results(v).select(F.explode(F.array(F.struct(F.col("truth").alias("label"), (F.col("truth") == F.col("pred")).cast("int").alias("hit")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("hit")))).alias("s")).select("s.*")
    labels = v.sparkSession.range(10).select(F.col("id").alias("label"))
    f1 = sides.groupBy("label").agg((2.0 * F.sum("hit") / F.count(F.lit(1))).alias("f1"))
    return labels.join(f1, "label", "left").select("label", r6(F.coalesce("f1", F.lit(0.0))).alias("f1"))


MATCHES = """c as (select e.clip_id, e.expected_id, t.track_id, abs(e.start_s-t.start_frame/9e0)+abs(e.end_s-(t.end_frame+1)/9e0)/4 as score from v_expected e join v_tracks t on e.clip_id=t.clip_id)
"""


@query("j10_expected_candidates", "v_expected", "v_tracks", sql=MATCHES + "select clip_id, expected_id, track_id, round(score, 6) as score from c where score<=8")
def j10(e, t):
    score = F.abs(F.col("start_s") - F.col("start_frame") / 9.0) + F.abs(F.col("end_s") - (F.col("end_frame") + 1) / 9.0) / 4
    return e.join(t, "clip_id").withColumn("score", score).where("score <= 8").select("clip_id", "expected_id", "track_id", r6("score").alias("score"))


@query("a45_regression_status", "v_expected", "v_tracks", sql="m as (select e.clip_id, expected_id, abs(start_s-start_frame/9e0)+abs(end_s-(end_frame+1)/9e0) as err, (expected_id%4)/1e1 as was from v_expected e join v_tracks t on t.track_id=e.expected_id), s as (select *, case when err<was-1e-9 then 'improved' when err>was+1e-9 then 'worse' else 'same' end as status from m) select status, count(*) as n, round(1e2*count(*)/(select count(*) from s), 6) as percent from s group by status")
def a45(e, t):
    both = e.join(t.withColumnRenamed("track_id", "expected_id").drop("clip_id"), "expected_id")
    err = F.abs(F.col("start_s") - F.col("start_frame") / 9.0) + F.abs(F.col("end_s") - (F.col("end_frame") + 1) / 9.0)
    was = (F.col("expected_id") % 4) / 10.0
    s = both.withColumn("status", F.when(err < was - 1e-9, "improved").when(err > was + 1e-9, "worse").otherwise("same")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return s.select("status", "n", r6(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("percent"))


@query("u03_unmatched", "v_expected", "v_tracks", sql=MATCHES + ", k as (select * from c where round(score, 6)<=2e-1) select 'expected' as side, expected_id as id from v_expected where expected_id not in (select expected_id from k) union all select 'generated', track_id from v_tracks where track_id not in (select track_id from k)")
def u03(e, t):
    k = j10(e, t).where("score <= 0.2")
    left = e.select("expected_id").join(k, "expected_id", "left_anti").select(F.lit("expected").alias("side"), F.col("expected_id").alias("id"))
    return left.union(t.select("track_id").join(k, "track_id", "left_anti").select(F.lit("generated"), "track_id"))


@query("a46_score_by_class", "v_predictions", sql="select true_idx as truth, idx as pred, round(avg(score), 6) as mean, round(quantile_cont(score, 5e-1), 6) as median, round(max(score), 6) as most from v_predictions group by 1,2")
def a46(v):
    return v.groupBy(F.col("true_idx").alias("truth"), F.col("idx").alias("pred")).agg(r6(F.avg("score")).alias("mean"), r6(F.percentile("score", F.lit(0.5))).alias("median"), r6(F.max("score")).alias("most"))


