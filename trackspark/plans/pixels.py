"""w10-w16, a09, a11, a47-a53, x09-x15, m08, f13, f14, f16, k07: pixels and features."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackspark.operators import pixels as px

from .base import query, r6

P = "v_pixels"
PIX = "(partition by clip_id, y, x order by frame_number{})"
STATS = "fs as (select clip_id, frame_number, min(v) as low, max(v) as high, quantile_cont(v, 5e-1) as median, avg(v) as mean, stddev_pop(v) as std from v_pixels group by 1,2)\n"


@query("a09_clip_statistics", P, sql=STATS + "select clip_id, round(min(low), 6) as low, round(max(high), 6) as high, round(avg(trunc(mean)), 6) as mean, round(avg(median), 6) as median, count(*) as frames from fs group by clip_id")
def a09(v):
    s = px.frame_statistics(v)
    return s.groupBy("clip_id").agg(r6(F.min("low")).alias("low"), r6(F.max("high")).alias("high"), r6(F.avg(F.col("mean").cast("long").cast("double"))).alias("mean"), r6(F.avg("median")).alias("median"), F.count(F.lit(1)).alias("frames"))


@query("a11_value_limits", P, sql=STATS + "select p.clip_id, round(min(v-median), 6) as low, round(max(v-median), 6) as high from v_pixels p join fs on p.clip_id=fs.clip_id and p.frame_number=fs.frame_number group by 1")
def a11(v):
    s = px.frame_statistics(v).select("clip_id", "frame_number", "median")
    d = F.col("v") - F.col("median")
    return v.join(s, ["clip_id", "frame_number"]).groupBy("clip_id").agg(r6(F.min(d)).alias("low"), r6(F.max(d)).alias("high"))


@query("w10_running_mean", P, sql=f"select clip_id, frame_number, y, x, round(avg(v) over {PIX.format(' rows between 44 preceding and current row')}, 6) as mean from v_pixels")
def w10(v):
    return px.running_mean(v).select("clip_id", "frame_number", "y", "x", r6("mean").alias("mean"))


@query("w11_change_counts", P, sql=f"d as (select clip_id, frame_number, greatest(v, 29e2)-lag(greatest(v, 29e2), 5) over {PIX.format('')} as d from v_pixels) select clip_id, frame_number, count(*) filter (where d>5e1) as changed from d group by 1,2")
def w11(v):
    return px.change_counts(v, 5, 2900.0, 50.0)


@query("w12_trigger_runs", "v_stream", sql="""h as (select *, motion and not ffc as hit, sum(case when motion and not ffc then 0 else 1 end) over (partition by camera order by ts, event_id rows between unbounded preceding and current row) as island from v_stream)
select event_id, cast(sum(case when hit then 1 else 0 end) over (partition by camera, island order by ts, event_id rows between unbounded preceding and current row) as bigint) as run from h""")
def w12(s):
    return px.trigger_runs(s, F.col("motion"), F.col("ffc"), "camera", "ts", "event_id").select("event_id", "run")


@query("w13_delta_variance", P, sql=f"""n as (select *, (v-min(v) over (partition by clip_id, frame_number))/(max(v) over (partition by clip_id, frame_number)-min(v) over (partition by clip_id, frame_number)) as nv from v_pixels),
d as (select clip_id, frame_number, y, x, abs(nv-lag(nv) over {PIX.format('')}) as d from n) select clip_id, frame_number, round(var_pop(d), 6) as variance from d where d is not null and x between 2 and 5 and y between 1 and 6 group by 1,2""")
def w13(v):
    d = v.withColumn("nv", px.normalised(F.col("v"))).withColumn("d", F.abs(F.col("nv") - F.lag("nv").over(px.pixel())))
    inside = d.where("d is not null and x between 2 and 5 and y between 1 and 6")
    return inside.groupBy("clip_id", "frame_number").agg(r6(F.var_pop("d")).alias("variance"))


@query("w14_minimum_background", P, sql=f"select clip_id, frame_number, y, x, round(min(v) over {PIX.format(' rows between unbounded preceding and current row')}, 6) as background from v_pixels")
def w14(v):
    return v.select("clip_id", "frame_number", "y", "x", r6(F.min("v").over(px.pixel().rowsBetween(Window.unboundedPreceding, 0))).alias("background"))


WEIGHTED = """g as (select clip_id, y, x, list(v order by frame_number) as f from v_pixels group by 1,2,3),
r(clip_id, y, x, f, i, bg, w) as (select clip_id, y, x, f, 0::bigint, f[1], 0e0 from g union all select clip_id, y, x, f, i+1, case when bg>=f[i+1]-w then f[i+1] else bg end, case when bg>=f[i+1]-w then 0e0 else w+{step} end from r where i<len(f))
"""


@query("w15_weighted_background", P, sql=WEIGHTED.format(step="1e1") + "select clip_id, y, x, round(bg, 6) as background from r where i=len(f)")
def w15(v):
    return px.weighted_background(v, 10.0).select("clip_id", "y", "x", r6("background").alias("background"))


@query("w16_masked_mean_background", P, sql="""g as (select clip_id, y, x, list(v order by frame_number) as f from v_pixels group by 1,2,3),
r(clip_id, y, x, f, i, s, n) as (select clip_id, y, x, f, 1::bigint, f[1], 1 from g union all select clip_id, y, x, f, i+1, case when abs(f[i+1]-s/n)<=5e1 then s+f[i+1] else s end, case when abs(f[i+1]-s/n)<=5e1 then n+1 else n end from r where i<len(f))
select clip_id, y, x, round(s/n, 6) as background from r where i=len(f)""")
def w16(v):
    return px.masked_mean_background(v).select("clip_id", "y", "x", r6("background").alias("background"))


NORMAL = "n as (select *, min(v) over w as low, max(v) over w as high from v_pixels window w as (partition by clip_id, frame_number))\n"


@query("x09_normalise", P, sql=NORMAL + "select clip_id, frame_number, y, x, round(case when high=low then case when high=0 then 0 else v/high end else (v-low)/(high-low)*255 end, 6) as v from n")
def x09(v):
    return v.select("clip_id", "frame_number", "y", "x", r6(px.normalised(F.col("v"), 255.0)).alias("v"))


@query("x10_scale_values", "embeddings", sql="select vec_id, array_to_string(list_transform(embedding[1:4], lambda e: printf('%.4f', cast(e as double)*1e2/1275e-1-1)), ',') as scaled from embeddings")
def x10(e):
    scaled = F.transform(F.slice("embedding", 1, 4), lambda x: F.format_string("%.4f", x.cast("double") * 100 / 127.5 - 1))
    return e.select("vec_id", F.array_join(scaled, ",").alias("scaled"))


@query("x11_calibrated_difference", P, sql="""b as (select clip_id, y, x, min(v) as bg from v_pixels group by 1,2,3), d as (select p.clip_id, p.frame_number, p.y, p.x, v-bg as d from v_pixels p join b on p.clip_id=b.clip_id and p.y=b.y and p.x=b.x)
select clip_id, frame_number, y, x, round(greatest(0, d-avg(d) over (partition by clip_id, frame_number)), 6) as v from d""")
def x11(v):
    bg = v.groupBy("clip_id", "y", "x").agg(F.min("v").alias("bg"))
    d = v.join(bg, ["clip_id", "y", "x"]).withColumn("d", F.col("v") - F.col("bg"))
    return d.select("clip_id", "frame_number", "y", "x", r6(F.greatest(F.lit(0.0), F.col("d") - F.avg("d").over(px.frame()))).alias("v"))


@query("x12_crop_pixels", P, sql="select clip_id, frame_number, y-1 as y, x-2 as x, round(v, 6) as v from v_pixels where x>=2 and x<6 and y>=1 and y<7")
def x12(v):
    return v.where("x >= 2 and x < 6 and y >= 1 and y < 7").select("clip_id", "frame_number", (F.col("y") - 1).alias("y"), (F.col("x") - 2).alias("x"), r6("v").alias("v"))


@query("x14_tile_frames", P, sql="select clip_id, cast(floor(frame_number/9) as bigint) as tile, cast(floor(frame_number%9/3) as bigint)*8+y as y, (frame_number%9%3)*8+x as x, round(v, 6) as v from v_pixels")
def x14(v):
    i = F.col("frame_number") % 9
    return v.select("clip_id", F.floor(F.col("frame_number") / 9).alias("tile"), (F.floor(i / 3) * 8 + F.col("y")).alias("y"), ((i % 3) * 8 + F.col("x")).alias("x"), r6("v").alias("v"))


@query("x15_augment", P, sql="select clip_id, frame_number, y, 7-x as x, round((v+1e1-3e3)*12e-1+3e3, 6) as v from v_pixels")
def x15(v):
    return v.select("clip_id", "frame_number", "y", (7 - F.col("x")).alias("x"), r6((F.col("v") + 10.0 - 3000.0) * 1.2 + 3000.0).alias("v"))


@query("m08_preprocess", P, sql=STATS + """, d as (select p.clip_id, p.frame_number, y, x, v-median as d from v_pixels p join fs on p.clip_id=fs.clip_id and p.frame_number=fs.frame_number where x between 1 and 6 and y between 1 and 6),
c as (select *, case when quantile_cont(d, 5e-1) over w>0 then greatest(d, 0) else d end as c from d window w as (partition by clip_id, frame_number)), l as (select clip_id, min(c) as lo, max(c) as hi from c group by 1)
select c.clip_id, frame_number, y, x, round((c-lo)/(hi-lo), 6) as v from c join l on l.clip_id=c.clip_id""")
def m08(v):
    s = px.frame_statistics(v).select("clip_id", "frame_number", "median")
    d = v.where("x between 1 and 6 and y between 1 and 6").join(s, ["clip_id", "frame_number"]).withColumn("d", F.col("v") - F.col("median"))
    warm = F.percentile("d", F.lit(0.5)).over(px.frame()) > 0
    c = d.withColumn("c", F.when(warm, F.greatest(F.col("d"), F.lit(0.0))).otherwise(F.col("d")))
    limits = c.groupBy("clip_id").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    return c.join(limits, "clip_id").select("clip_id", "frame_number", "y", "x", r6((F.col("c") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("v"))


@query("f13_pixel_range_guard", P, sql=STATS + "select clip_id, frame_number, high>31e2 or low<29e2 as rejected, low=0 as skipped from fs")
def f13(v):
    return px.frame_statistics(v).select("clip_id", "frame_number", ((F.col("high") > 3100) | (F.col("low") < 2900)).alias("rejected"), (F.col("low") == 0).alias("skipped"))


@query("f14_bad_samples", "embeddings", sql="select vec_id from embeddings where len(embedding)>0 and vec_id%13<>0 and len(list_filter(embedding, lambda e: isnan(e)))=0")
def f14(e):
    broken = F.when(F.col("vec_id") % 13 == 0, F.array().cast("array<float>")).otherwise(F.col("embedding"))
    return e.withColumn("e", broken).where((F.size("e") > 0) & ~F.exists("e", F.isnan)).select("vec_id")


@query("f16_flat_frames", P, sql="q as (select clip_id, frame_number, case when frame_number%9=0 then 3e3 else v end as v from v_pixels) select clip_id, frame_number from q group by 1,2 having max(v)<>min(v)")
def f16(v):
    q = v.withColumn("v", F.when(F.col("frame_number") % 9 == 0, 3000.0).otherwise(F.col("v")))
    return q.groupBy("clip_id", "frame_number").agg((F.max("v") != F.min("v")).alias("ok")).where("ok").select("clip_id", "frame_number")


@query("k07_brightest_block", P, sql="""m as (select clip_id, frame_number from (select clip_id, frame_number, row_number() over (partition by clip_id order by round(avg(v), 6) desc, frame_number) as r from v_pixels group by 1,2) where r=1),
b as (select p.clip_id, o.y as oy, q.x as ox, avg(v) as v from v_pixels p join m on p.clip_id=m.clip_id and p.frame_number=m.frame_number, range(0,5) o(y), range(0,5) q(x) where p.y between o.y and o.y+3 and p.x between q.x and q.x+3 group by 1,2,3)
select clip_id, oy as y, ox as x from (select *, row_number() over (partition by clip_id order by round(v, 6) desc, oy, ox) as r from b) where r=1""")
def k07(v):
    clip = Window.partitionBy("clip_id")
    mean = v.groupBy("clip_id", "frame_number").agg(r6(F.avg("v")).alias("m"))
    top = mean.withColumn("r", F.row_number().over(clip.orderBy(F.desc("m"), "frame_number"))).where("r = 1").select("clip_id", "frame_number")
    # every pixel counts for the blocks that hold it
    corner = lambda c: F.explode(F.sequence(F.greatest(F.lit(0), F.col(c) - 3).cast("long"), F.least(F.lit(4), F.col(c)).cast("long")))
    blocks = v.join(top, ["clip_id", "frame_number"]).withColumn("oy", corner("y")).withColumn("ox", corner("x")).groupBy("clip_id", "oy", "ox").agg(r6(F.avg("v")).alias("b"))
    return blocks.withColumn("r", F.row_number().over(clip.orderBy(F.desc("b"), "oy", "ox"))).where("r = 1").select("clip_id", F.col("oy").alias("y"), F.col("ox").alias("x"))


@query("a47_intensity_features", P, sql=STATS + """, b as (select clip_id, y, x, min(v) as bg from v_pixels group by 1,2,3), f as (select p.*, v-bg as d from v_pixels p join b on p.clip_id=b.clip_id and p.y=b.y and p.x=b.x)
select clip_id, frame_number, round(min(v), 6) as low, round(max(v), 6) as high, round(stddev_pop(v), 6) as std, round(min(d), 6) as f_low, round(max(d), 6) as f_high, round(stddev_pop(d), 6) as f_std, round(max(d)/nullif(stddev_pop(v), 0), 6) as peak_snr, round(avg(d)/nullif(stddev_pop(v), 0), 6) as mean_snr, round(count(*) filter (where d>5e1)/cast(count(*) as double), 6) as fill from f group by 1,2""")
def a47(v):
    bg = v.groupBy("clip_id", "y", "x").agg(F.min("v").alias("bg"))
    f = v.join(bg, ["clip_id", "y", "x"]).withColumn("d", F.col("v") - F.col("bg"))
    sd = F.nullif(F.stddev_pop("v"), F.lit(0.0))
    return f.groupBy("clip_id", "frame_number").agg(
        r6(F.min("v")).alias("low"), r6(F.max("v")).alias("high"), r6(F.stddev_pop("v")).alias("std"), r6(F.min("d")).alias("f_low"), r6(F.max("d")).alias("f_high"), r6(F.stddev_pop("d")).alias("f_std"),
        r6(F.max("d") / sd).alias("peak_snr"), r6(F.avg("d") / sd).alias("mean_snr"), r6(F.count(F.when(F.col("d") > 50, 1)) / F.count(F.lit(1))).alias("fill"),
    )


MOMENTS = """w as (select *, v-min(v) over (partition by clip_id, frame_number) as w from v_pixels), s as (select clip_id, frame_number, sum(w) as s, sum(w*x) as sx, sum(w*y) as sy, sum(w*x*x) as sxx, sum(w*y*y) as syy, sum(w*x*y) as sxy from w group by 1,2),
c as (select clip_id, frame_number, sx/s as cx, sy/s as cy, sxx/s-power(sx/s, 2) as a, syy/s-power(sy/s, 2) as d, sxy/s-(sx/s)*(sy/s) as b from s)
"""


@query("a48_moments", P, sql=MOMENTS + "select clip_id, frame_number, round(cx, 5) as cx, round(cy, 5) as cy, round(sqrt((a+d)/2+sqrt(power((a-d)/2, 2)+b*b)), 5) as major, round(sqrt(greatest(0e0, (a+d)/2-sqrt(power((a-d)/2, 2)+b*b))), 5) as minor from c")
def a48(v):
    return px.moments(v).select("clip_id", "frame_number", *[F.round(c, 5).alias(c) for c in ("cx", "cy", "major", "minor")])


@query("a49_speeds", P, sql=MOMENTS + ", l as (select *, lag(cx, 1) over w as c1, lag(cy, 1) over w as d1, lag(cx, 3) over w as c3, lag(cy, 3) over w as d3 from c window w as (partition by clip_id order by frame_number)) select clip_id, frame_number, round(sqrt(power(cx-c1, 2)+power(cy-d1, 2)), 5) as speed_1, round(sqrt(power(cx-c3, 2)+power(cy-d3, 2))/sqrt(64e0), 5) as relative_3 from l")
def a49(v):
    w = Window.partitionBy("clip_id").orderBy("frame_number")
    step = lambda k: F.sqrt((F.col("cx") - F.lag("cx", k).over(w)) ** 2 + (F.col("cy") - F.lag("cy", k).over(w)) ** 2)
    return px.moments(v).select("clip_id", "frame_number", F.round(step(1), 5).alias("speed_1"), F.round(step(3) / 8.0, 5).alias("relative_3"))


FEATURES = ("low", "high", "median", "mean", "std")


@query("a50_feature_aggregates", P, sql=STATS + "select clip_id, " + ", ".join(f"round(avg({c}), 5) as avg_{c}, round(stddev_pop({c}), 5) as std_{c}, round(max({c}), 5) as max_{c}, round(min(nullif({c}, 0)), 5) as min_{c}, round(max({c})-min({c}), 5) as range_{c}" for c in FEATURES) + " from fs group by clip_id")
def a50(v):
    r5 = lambda c, n: F.round(c, 5).alias(n)
    aggs = [a for c in FEATURES for a in (r5(F.avg(c), f"avg_{c}"), r5(F.stddev_pop(c), f"std_{c}"), r5(F.max(c), f"max_{c}"), r5(F.min(F.nullif(F.col(c), F.lit(0.0))), f"min_{c}"), r5(F.max(c) - F.min(c), f"range_{c}"))]
    return px.frame_statistics(v).groupBy("clip_id").agg(*aggs)


@query("a51_bursts", "v_regions", sql="""m as (select track_id, frame_number, sqrt(power(x-lag(x) over w, 2)+power(y-lag(y) over w, 2)) as speed from v_regions window w as (partition by track_id order by frame_number)),
a as (select *, coalesce(speed>avg(speed) over (partition by track_id), false) as fast from m), i as (select *, sum(case when fast then 0 else 1 end) over (partition by track_id order by frame_number rows between unbounded preceding and current row) as island from a),
r as (select track_id, island, count(*) as n from i where fast group by 1,2), t as (select track_id, count(*) as frames from v_regions group by 1)
select t.track_id, count(r.n) as bursts, coalesce(max(r.n), 0) as longest, round(coalesce(sum(r.n), 0)/cast(frames as double), 6) as share from t left join r using (track_id) group by t.track_id, frames""")
def a51(v):
    w = Window.partitionBy("track_id").orderBy("frame_number")
    m = v.withColumn("speed", F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2))
    a = m.withColumn("fast", F.coalesce(F.col("speed") > F.avg("speed").over(Window.partitionBy("track_id")), F.lit(False)))
    i = a.withColumn("island", F.sum((~F.col("fast")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = i.where("fast").groupBy("track_id", "island").agg(F.count(F.lit(1)).alias("n")).groupBy("track_id").agg(F.count("n").alias("bursts"), F.max("n").alias("longest"), F.sum("n").alias("all"))
    t = v.groupBy("track_id").agg(F.count(F.lit(1)).alias("frames")).join(r, "track_id", "left").fillna(0)
    return t.select("track_id", "bursts", "longest", r6(F.col("all") / F.col("frames")).alias("share"))


@query("a52_standardise", P, sql=STATS + ", n as (select clip_id, frame_number, (mean-avg(mean) over ())/stddev_pop(mean) over () as z_mean, (std-avg(std) over ())/stddev_pop(std) over () as z_std from fs) select clip_id, frame_number, round(z_mean, 5) as z_mean, round(z_std, 5) as z_std from n")
def a52(v):
    s = px.frame_statistics(v)
    norms = s.agg(*[f(c).alias(f"{n}_{c}") for c in ("mean", "std") for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda c: F.round((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}"), 5).alias(f"z_{c}")
    return s.crossJoin(F.broadcast(norms)).select("clip_id", "frame_number", z("mean"), z("std"))  # one row of norms


@query("a53_histogram_correlation", P, sql="""n as (select clip_id, frame_number, x<4 as half, least(59, cast(floor(6e1*(v-min(v) over w)/(max(v) over w-min(v) over w)) as bigint)) as bin from v_pixels window w as (partition by clip_id, frame_number)),
g as (select f.clip_id, f.frame_number, b.i as bin from (select distinct clip_id, frame_number from n) f, range(60) b(i)), h as (select g.clip_id, g.frame_number, g.bin, count(*) filter (where half) as a, count(*) filter (where not half) as b from g left join n on g.clip_id=n.clip_id and g.frame_number=n.frame_number and g.bin=n.bin group by 1,2,3)
select clip_id, frame_number, round(corr(a, b), 6) as correlation from h group by 1,2""")
def a53(v):
    bins = v.select("clip_id", "frame_number", (F.col("x") < 4).alias("half"), F.least(F.lit(59), F.floor(px.normalised(F.col("v"), 60.0))).cast("long").alias("bin"))
    grid = bins.select("clip_id", "frame_number").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(59).cast("long"))))
    n = bins.groupBy("clip_id", "frame_number", "bin").agg(F.count(F.when(F.col("half"), 1)).alias("a"), F.count(F.when(~F.col("half"), 1)).alias("b"))
    return grid.join(n, ["clip_id", "frame_number", "bin"], "left").fillna(0).groupBy("clip_id", "frame_number").agg(r6(F.corr("a", "b")).alias("correlation"))
