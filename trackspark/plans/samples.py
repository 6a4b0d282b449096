"""p01-p08, p12-p14, w08, w09, w18, f06, f15, f18, k04, k05, k12, a12, a14-a22, j04, j15, u01, u02, u04, u05, x13, s07, s08, s10: samples and data sets."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackspark.operators import samples as s
from trackspark.sources.documents import shared_folder

from .base import query, r6

USABLE = "u as (select track_id, frame_number, mass, width*height as area, greatest(width,height)/cast(least(width,height) as double) as elongation, x<=1 or y<=1 or x+width>=158 or y+height>=118 as border from v_regions where not blank and not ffc and mass>0)"
JOINED = "array_to_string(frames, ',') as frames"


def usable(v):
    border = (F.col("x") <= 1) | (F.col("y") <= 1) | (F.col("x") + F.col("width") >= 158) | (F.col("y") + F.col("height") >= 118)
    return v.where("not blank and not ffc and mass > 0").select(
        "track_id", "frame_number", "mass", (F.col("width") * F.col("height")).alias("area"), (F.greatest("width", "height") / F.least("width", "height")).alias("elongation"), border.alias("border")
    )


def joined(df, *keys):
    return df.select(*keys, F.array_join(F.col("frames").cast("array<string>"), ",").alias("frames"))


RANDOM = USABLE + """, r as (select *, row_number() over (partition by track_id order by md5(concat_ws('|','{seed}',track_id,frame_number)), track_id, frame_number) as rn from u{where}),
g as (select track_id, cast(floor((rn-1)/{width}) as bigint) as segment, list_sort(list(frame_number)) as frames from r group by 1, 2)
"""


@query("p01_random_segments", "v_regions", sql=RANDOM.format(seed="p01", width=10, where="") + f"select track_id, segment, {JOINED} from g")
def p01(v):
    return joined(s.random_segments(usable(v), 10, "p01"), "track_id", "segment")


@query("p03_section_segments", "v_regions", sql=USABLE + f""", n as (select *, row_number() over (partition by track_id order by frame_number)-1 as i from u),
e as (select *, unnest(range(cast(greatest(0, ceil((i-21)/1e1)) as bigint), cast(floor(i/1e1) as bigint)+1)) as segment from n),
r as (select *, row_number() over (partition by track_id, segment order by md5(concat_ws('|','p03',segment,track_id,frame_number))) as rn from e),
g as (select track_id, segment, list_sort(list(frame_number)) as frames from r where rn<=10 group by 1, 2)
select track_id, segment, {JOINED} from g""")
def p03(v):
    return joined(s.section_segments(usable(v), 10, 2.2, "p03"), "track_id", "segment")


@query("p04_top_random_segments", "v_regions", sql=USABLE + """, k as (select * from (select *, row_number() over (partition by track_id order by mass desc, frame_number) as top from u) where top<=30),
r as (select *, row_number() over (partition by track_id order by md5(concat_ws('|','p04',track_id,frame_number)), track_id, frame_number) as rn from k),
g as (select track_id, cast(floor((rn-1)/10) as bigint) as segment, list_sort(list(frame_number)) as frames from r group by 1, 2)
""" + f"select track_id, segment, {JOINED} from g")
def p04(v):
    top = usable(v).withColumn("top", F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("mass"), "frame_number"))).where("top <= 30")
    return joined(s.random_segments(top, 10, "p04"), "track_id", "segment")


@query("p05_segment_acceptance", "v_regions", sql=RANDOM.format(seed="p05", width=16, where="") + f"select track_id, segment, {JOINED} from g where len(frames)*4>=16 and (segment=0 or len(frames)*2>=16)")
def p05(v):
    return joined(s.accepted(s.random_segments(usable(v), 16, "p05"), 16), "track_id", "segment")


@query("p06_top_up", "v_regions", sql=RANDOM.format(seed="p06", width=16, where="") + "select track_id, segment, array_to_string(list_transform(range(16), lambda i: frames[i%len(frames)+1]), ',') as frames from g")
def p06(v):
    found = s.random_segments(usable(v), 16, "p06")
    return joined(found.withColumn("frames", s.topped_up(F.col("frames"), 16)), "track_id", "segment")


@query("p07_frame_cap", "v_regions", sql=USABLE + ", r as (select *, row_number() over (partition by track_id order by md5(concat_ws('|','p07',track_id,frame_number)), track_id, frame_number) as rn from u) select track_id, frame_number from r where rn<=25")
def p07(v):
    return s.ranked(usable(v), ["track_id"], "p07", "track_id", "frame_number").where("rn <= 25").select("track_id", "frame_number")


@query("w08_sequential_segments", "v_regions", sql=USABLE + f""", n as (select *, row_number() over (partition by track_id order by frame_number)-1 as i from u),
e as (select *, unnest(range(cast(greatest(0, ceil((i-9)/4e0)) as bigint), cast(floor(i/4e0) as bigint)+1)) as segment from n),
g as (select track_id, segment, list_sort(list(frame_number)) as frames from e group by 1, 2)
select track_id, segment, {JOINED} from g where len(frames)=10""")
def w08(v):
    return joined(s.sequential_segments(usable(v), 10, 4), "track_id", "segment")


@query("w09_mass_windows", "v_regions", sql="""w as (select track_id, frame_number, sum(mass) over r as total, count(*) over r as n, max(case when ffc then 1 else 0 end) over r as bad from v_regions window r as (partition by track_id order by frame_number rows between current row and 9 following))
select track_id, frame_number, cast(total as bigint) as total, cast(row_number() over (partition by track_id order by total desc, frame_number) as bigint) as rank from w where n=10 and bad=0""")
def w09(v):
    win = Window.partitionBy("track_id").orderBy("frame_number").rowsBetween(0, 9)
    sums = v.select("track_id", "frame_number", F.sum("mass").over(win).alias("total"), F.count(F.lit(1)).over(win).alias("n"), F.max(F.col("ffc").cast("int")).over(win).alias("bad"))
    rank = F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("total"), "frame_number")).cast("long")
    return sums.where("n = 10 and bad = 0").select("track_id", "frame_number", "total", rank.alias("rank"))


@query("f06_frame_samples", "v_regions", sql=USABLE.replace("where not blank and not ffc and mass>0", "where not blank and not ffc and mass>0 and frame_number%17<>4") + """, q as (select track_id, quantile_cont(mass, 25e-2) as lo, quantile_cont(mass, 75e-2) as hi from v_regions group by track_id),
k as (select u.*, last_value(case when not border then mass end ignore nulls) over (partition by u.track_id order by frame_number rows between unbounded preceding and 1 preceding) as good from u join q on u.track_id=q.track_id where mass>=lo and mass<=hi)
select track_id, frame_number from k where not border or good is null or abs(good-mass)<good*1e-1""")
def f06(v):
    q = v.groupBy("track_id").agg(F.percentile("mass", F.lit(0.25)).alias("lo"), F.percentile("mass", F.lit(0.75)).alias("hi"))
    kept = usable(v).where("frame_number % 17 <> 4").join(q, "track_id").where("mass >= lo and mass <= hi")
    before = Window.partitionBy("track_id").orderBy("frame_number").rowsBetween(Window.unboundedPreceding, -1)
    good = F.last(F.when(~F.col("border"), F.col("mass")), ignorenulls=True).over(before)
    return kept.withColumn("good", good).where(~F.col("border") | F.col("good").isNull() | (F.abs(F.col("good") - F.col("mass")) < F.col("good") * 0.1)).select("track_id", "frame_number")


@query("f18_segment_mass_filter", "v_regions", sql="""g as (select track_id, cast(floor(frame_number/10) as bigint) as segment, avg(mass) as m from v_regions group by 1,2), q as (select track_id, quantile_cont(mass, 5e-1) as md from v_regions group by 1)
select g.track_id, segment, m<least(50, md) as light from g join q on g.track_id=q.track_id""")
def f18(v):
    g = v.groupBy("track_id", F.floor(F.col("frame_number") / 10).alias("segment")).agg(F.avg("mass").alias("m"))
    q = v.groupBy("track_id").agg(F.percentile("mass", F.lit(0.5)).alias("md"))
    return g.join(q, "track_id").select("track_id", "segment", (F.col("m") < F.least(F.lit(50.0), F.col("md"))).alias("light"))


@query("k04_top_mass_frames", "v_regions", sql=USABLE + " select track_id, frame_number from (select *, row_number() over (partition by track_id order by mass desc, frame_number) as r from u) where r<=20")
def k04(v):
    return usable(v).withColumn("r", F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("mass"), "frame_number"))).where("r <= 20").select("track_id", "frame_number")


@query("k05_elongation_segment", "v_regions", sql=USABLE + """, a as (select *, row_number() over (partition by track_id, border order by elongation desc, frame_number) as re, row_number() over (partition by track_id, border order by area desc, frame_number) as ra, count(*) filter (where not border) over (partition by track_id) as inner_n from u)
select track_id, frame_number from a where (not border and re<=8) or (border and least(inner_n, 8)<4 and ra<=8-least(inner_n, 8))""")
def k05(v):
    side = Window.partitionBy("track_id", "border")
    inner = F.least(F.sum((~F.col("border")).cast("int")).over(Window.partitionBy("track_id")), F.lit(8))
    a = usable(v).withColumn("re", F.row_number().over(side.orderBy(F.desc("elongation"), "frame_number"))).withColumn("ra", F.row_number().over(side.orderBy(F.desc("area"), "frame_number"))).withColumn("inner", inner)
    return a.where((~F.col("border") & (F.col("re") <= 8)) | (F.col("border") & (F.col("inner") < 4) & (F.col("ra") <= 8 - F.col("inner")))).select("track_id", "frame_number")


@query("a12_sample_summary", "v_regions", sql="select track_id, cast(floor(frame_number/25) as bigint) as segment, cast(round_even(sum(mass)/cast(count(*) as double), 0) as bigint) as mass, cast(round_even(sqrt(avg(width*height)), 0) as bigint) as dimension from v_regions group by 1,2")
def a12(v):
    return v.groupBy("track_id", F.floor(F.col("frame_number") / 25).alias("segment")).agg(F.bround(F.sum("mass") / F.count(F.lit(1)), 0).cast("long").alias("mass"), F.bround(F.sqrt(F.avg(F.col("width") * F.col("height"))), 0).cast("long").alias("dimension"))


@query("x13_padding", "v_regions", sql="g as (select track_id, list_sort(list(frame_number)) as f from v_regions where frame_number<track_id%12 group by track_id) select track_id, array_to_string(list_concat(f, list_transform(range(12-len(f)), lambda i: 0::bigint)), ',') as frames from g")
def x13(v):
    g = v.where("frame_number < track_id % 12").groupBy("track_id").agg(F.array_sort(F.collect_list("frame_number")).alias("f"))
    return joined(g.withColumn("frames", F.concat("f", F.array_repeat(F.lit(0).cast("long"), (12 - F.size("f")).cast("int")))), "track_id")


SPLIT = "cast(case when sample_id%20<16 then 'train' when sample_id%20<19 then 'validation' else 'test' end as varchar) as split"


def split(v):
    m = F.col("sample_id") % 20
    return v.withColumn("split", F.when(m < 16, "train").when(m < 19, "validation").otherwise("test"))


def counts(v):
    return v.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


N = "c as (select label, count(*) as n from v_samples group by label)"


@query("a14_split_counts", "v_samples", sql=f"s as (select *, {SPLIT} from v_samples) select split, label, count(*) as samples, count(distinct track_id) as tracks, count(distinct station_id) as bins, cast(sum(mass) as bigint) as mass from s group by split, label")
def a14(v):
    return split(v).groupBy("split", "label").agg(F.count(F.lit(1)).alias("samples"), F.countDistinct("track_id").alias("tracks"), F.countDistinct("station_id").alias("bins"), F.sum("mass").alias("mass"))


@query("a15_breakdowns", "v_samples", sql="select label, original_label, station_id, count(*) as n, count(distinct clip_id) as clips from v_samples group by grouping sets ((label), (label, original_label), (station_id), (station_id, label))")
def a15(v):
    return v.groupingSets([["label"], ["label", "original_label"], ["station_id"], ["station_id", "label"]], "label", "original_label", "station_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("clip_id").alias("clips"))


@query("a16_label_cap", "v_samples", sql=N + ", o as (select list_sort(list(n)) as l, max(n) filter (where label='bird') as birds from c) select coalesce(birds, l[cast(floor(len(l)*4e-1) as bigint)+1]) as cap from o")
def a16(v):
    return counts(v).agg(F.array_sort(F.collect_list("n")).alias("l"), F.max(F.when(F.col("label") == "bird", F.col("n"))).alias("birds")).select(F.coalesce("birds", F.element_at("l", (F.floor(F.size("l") * 0.4) + 1).cast("int"))).alias("cap"))


@query("a17_rough_balance", "v_samples", sql="""b as (select * from v_samples where label<>'1-URGENT' or sample_id%4=0), c as (select label, count(*) as n from b group by label), l as (select case when stddev_pop(n)>=2e2 and count(*)>1 then list_sort(list(n))[-2] else 1000000000 end as cap from c),
r as (select sample_id, label, row_number() over (partition by label order by md5(concat_ws('|','a17',sample_id)), sample_id) as rn from b) select sample_id, label from r, l where rn<=cap""")
def a17(v):
    b = v.where("label <> '1-URGENT' or sample_id % 4 = 0")
    cap = counts(b).agg(F.when((F.stddev_pop("n") >= 200) & (F.count(F.lit(1)) > 1), F.element_at(F.array_sort(F.collect_list("n")), -2)).otherwise(1000000000).alias("cap"))
    return s.ranked(b, ["label"], "a17", "sample_id").crossJoin(F.broadcast(cap)).where("rn <= cap").select("sample_id", "label")


@query("a18_class_weights", "v_samples", sql=N + ", d as (select * from c union all select 'none', 0) select label, case when n=0 then 0e0 else round(least(4e0, greatest(25e-2, (select sum(n) from d)/cast(n*(select count(*) from d where n>0) as double))), 6) end as weight from d")
def a18(v):
    d = counts(v).union(v.sparkSession.createDataFrame([("none", 0)], "label string, n long"))
    return s.clamped_weights(d).select("label", r6("weight").alias("weight"))


@query("a19_label_distribution", "v_samples", sql="e as (select unnest([label, original_label]) as label from v_samples) select label, count(*) as n from e group by label")
def a19(v):
    return v.select(F.explode(F.array("label", "original_label")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("a20_target_distribution", "v_samples", sql="""b as (select label, count(*) as n from v_samples where label<>'1-URGENT' or sample_id%9=0 group by label), d as (select label, n/cast(sum(n) over () as double) as d, 1e0/count(*) over () as u from b), m as (select *, max(d) over () as mx from d),
t as (select label, case when mx-d>u then d else u end as t from m) select label, round(t/sum(t) over (), 6) as target from t""")
def a20(v):
    everything = Window.partitionBy(F.lit(0))  # one row per label
    d = counts(v.where("label <> '1-URGENT' or sample_id % 9 = 0")).withColumn("d", F.col("n") / F.sum("n").over(everything)).withColumn("u", 1.0 / F.count(F.lit(1)).over(everything))
    t = d.withColumn("t", F.when(F.max("d").over(everything) - F.col("d") > F.col("u"), F.col("d")).otherwise(F.col("u")))
    return t.select("label", r6(F.col("t") / F.sum("t").over(everything)).alias("target"))


@query("a21_label_space", "v_samples", sql="""d as (select distinct label from v_samples where label<>'5-LOW'), m as (select label, case label when '1-URGENT' then 'high' when '2-HIGH' then 'high' else label end as mapped from d)
select mapped, array_to_string(list_sort(list(label)), ',') as originals from m group by mapped""")
def a21(v):
    remap = v.sparkSession.createDataFrame([("1-URGENT", "high"), ("2-HIGH", "high")], "label string, to string")
    d = v.where("label <> '5-LOW'").select("label").distinct().join(F.broadcast(remap), "label", "left").withColumn("mapped", F.coalesce("to", "label"))
    return d.groupBy("mapped").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("originals"))


@query("a22_augmentation_plan", "v_samples", sql="""r as (select sample_id, track_id, row_number() over (partition by track_id order by md5(concat_ws('|','a22',sample_id)), sample_id) as rn, count(*) over (partition by track_id) as n from v_samples)
select sample_id, false as augment from v_samples union all select sample_id, true from r where rn<=floor(5e-1*n)""")
def a22(v):
    n = F.count(F.lit(1)).over(Window.partitionBy("track_id"))
    extra = s.ranked(v, ["track_id"], "a22", "sample_id").withColumn("n", n).where(F.col("rn") <= F.floor(0.5 * F.col("n")))
    return v.select("sample_id", F.lit(False).alias("augment")).union(extra.select("sample_id", F.lit(True)))


@query("p08_epoch_sample", "v_samples", sql=N + """, k as (select label, case label when '5-LOW' then cast(floor(1000*5e-1) as bigint) else least(1000, n) end as cap from c),
r as (select sample_id, label, row_number() over (partition by label order by md5(concat_ws('|','p08',sample_id)), sample_id) as rn from v_samples) select sample_id from r join k using (label) where rn<=cap""")
def p08(v):
    caps = counts(v).select("label", F.when(F.col("label") == "5-LOW", 500).otherwise(F.least(F.lit(1000), F.col("n"))).alias("cap"))
    return s.ranked(v, ["label"], "p08", "sample_id").join(F.broadcast(caps), "label").where("rn <= cap").select("sample_id")


LIMITS = (("validation", 0.15, 100, 50), ("test", 0.05, 40, 20))
FILL = """b as (select label, station_id as bin_id, count(*) as samples, count(distinct track_id) as tracks from v_samples group by 1, 2), o as (select *, md5(concat_ws('|','w18',bin_id)) as k from b), v as (select *, coalesce(sum(samples) over w, 0) as s, coalesce(sum(tracks) over w, 0) as t from o window w as (partition by label order by k, bin_id rows between unbounded preceding and 1 preceding)),
lim as (select label, greatest(sum(samples)*15e-2, 100) as vs, greatest(sum(tracks)*15e-2, 50) as vt, greatest(sum(samples)*5e-2, 40) as ts, greatest(sum(tracks)*5e-2, 20) as tt from b group by label),
x as (select v.*, vs, vt, ts, tt, (s<vs or t<vt) as val from v join lim using (label)), y as (select *, coalesce(sum(samples) over w, 0) as s2, coalesce(sum(tracks) over w, 0) as t2 from x where not val window w as (partition by label order by k, bin_id rows between unbounded preceding and 1 preceding))
"""


@query("w18_cumulative_fill", "v_samples", sql=FILL + "select label, bin_id, 'validation' as split from x where val union all select label, bin_id, case when s2<ts or t2<tt then 'test' else 'train' end from y")
def w18(v):
    bins = v.groupBy("label", F.col("station_id").alias("bin_id")).agg(F.count(F.lit(1)).alias("samples"), F.countDistinct("track_id").alias("tracks"))
    total = Window.partitionBy("label")
    lim = lambda c, share, least: F.greatest(F.sum(c).over(total) * share, F.lit(float(least)))
    wide = bins.select("*", *[lim(c, share, least).alias(f"{split}_{c}") for split, share, *both in LIMITS for c, least in zip(("samples", "tracks"), both, strict=True)])
    return s.fill_splits(wide, [(split, F.col(f"{split}_samples"), F.col(f"{split}_tracks")) for split, *_ in LIMITS], "w18").select("label", "bin_id", "split")


#: Labels with fewer tracks, or fewer stations than LEAST_BINS, are split by clip; the label that is always, too.
LEAST_TRACKS, LEAST_BINS, BY_CLIP = 100, 4, ("5-LOW",)
#: Labels are a dimension: more take no turns.
MOST_LABELS = 10_000


def binned(v, least_tracks=LEAST_TRACKS):
    """Samples with the bin that is never divided: the station, or the clip for labels with few bins or tracks."""
    g = v.groupBy("label").agg(F.countDistinct("station_id").alias("_bins"), F.countDistinct("track_id").alias("_tracks"))
    by_clip = F.col("label").isin(*BY_CLIP) | (F.col("_bins") < LEAST_BINS) | (F.col("_tracks") < least_tracks)
    bin_id = F.when(by_clip, F.concat(F.lit("c"), "clip_id")).otherwise(F.concat(F.lit("s"), "station_id"))
    # whether the rows of labels are few enough to be sent around is left to Spark, which measures them
    return v.join(g, "label").withColumn("bin_id", bin_id).drop("_bins", "_tracks")


def label_order(sizes):
    """label, place of labels with their n: those that are forced to the front or the end, else the smallest first."""
    forced = F.when(F.col("label") == "2-HIGH", 0).when(F.col("label") == "1-URGENT", 2).otherwise(1)
    return sizes.select("label", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(forced, "n", "label")).cast("long").alias("place"))


def group_split(v, least_tracks=LEAST_TRACKS):
    """sample_id, split: label by label in their order, bins fill validation, then test, then train.

    A bin that an earlier label has placed stays there, and its samples count towards the limits.  Samples are reduced once, to
    a row per label and bin; a track lies in one bin.  The labels, which are few, then take their turns on that table."""
    rows, spark, folder = binned(v, least_tracks), v.sparkSession, shared_folder(v.sparkSession, "bins")
    rows.groupBy("label", "bin_id").agg(F.count(F.lit(1)).alias("samples"), F.countDistinct("track_id").alias("tracks")).write.parquet(f"{folder}/all")
    bins = spark.read.parquet(f"{folder}/all")
    labels = [r["label"] for r in label_order(bins.groupBy("label").agg(F.sum("samples").alias("n"))).orderBy("place").limit(MOST_LABELS + 1).collect()]
    if len(labels) > MOST_LABELS:
        raise ValueError(f"over {MOST_LABELS} labels take turns one after another")
    placed, done = spark.createDataFrame([], "bin_id string, split string"), []
    for label in labels:
        own = bins.where(F.col("label") == label).join(placed, "bin_id", "left")
        by = Window.partitionBy("label")
        left = lambda n, split, share, least: F.greatest(F.sum(n).over(by) * share, F.lit(float(least))) - F.coalesce(F.sum(F.when(F.col("split") == split, F.col(n))).over(by), F.lit(0))
        wide = own.select("*", *[left(n, split, share, least).alias(f"{split}_{n}") for split, share, *both in LIMITS for n, least in zip(("samples", "tracks"), both, strict=True)])
        # a split that has enough of either takes no bin
        need = lambda split: [F.when((F.col(f"{split}_samples") > 0) & (F.col(f"{split}_tracks") > 0), F.col(f"{split}_{n}")).otherwise(0) for n in ("samples", "tracks")]
        path = f"{folder}/{len(done)}"
        s.fill_splits(wide.where("split is null").drop("split"), [(split, *need(split)) for split, *_ in LIMITS], "p09").select("bin_id", "split").write.parquet(path)
        done.append(path)
        placed = spark.read.schema("bin_id string, split string").parquet(*done)
    return rows.join(placed, "bin_id").select("sample_id", "split")


def split_sql(source, labels=5):
    """The same label by label, for as many labels as the table has."""
    parts = [f"""n0 as (select label, count(*) as n, count(distinct station_id) as bins, count(distinct track_id) as tracks from {source} group by label),
lo as (select label, row_number() over (order by case label when '2-HIGH' then 0 when '1-URGENT' then 2 else 1 end, n, label) as place from n0),
sb as materialized (select sample_id, track_id, place, case when label='5-LOW' or bins<4 or tracks<100 then 'c'||clip_id else 's'||station_id end as bin_id from {source} join n0 using (label) join lo using (label)),
pl0 as (select 'x' as bin_id, 'x' as split where false)"""]
    for i in range(1, labels + 1):
        parts.append(f"""o{i} as materialized (select s.*, split from sb s left join pl{i - 1} using (bin_id) where place={i}),
l{i} as materialized (select greatest(count(*)*15e-2, 100)-count(*) filter (where split='validation') as vs, greatest(count(distinct track_id)*15e-2, 50)-count(distinct track_id) filter (where split='validation') as vt, greatest(count(*)*5e-2, 40)-count(*) filter (where split='test') as ts, greatest(count(distinct track_id)*5e-2, 20)-count(distinct track_id) filter (where split='test') as tt from o{i}),
b{i} as (select bin_id, count(*) as n, count(distinct track_id) as t from o{i} where split is null group by 1),
v{i} as (select *, vs>0 and vt>0 and (coalesce(sum(n) over w, 0)<vs or coalesce(sum(t) over w, 0)<vt) as val from b{i}, l{i} window w as (order by md5(concat_ws('|','p09',bin_id)), bin_id rows between unbounded preceding and 1 preceding)),
t{i} as (select *, ts>0 and tt>0 and (coalesce(sum(n) over w, 0)<ts or coalesce(sum(t) over w, 0)<tt) as tes from v{i} where not val window w as (order by md5(concat_ws('|','p09',bin_id)), bin_id rows between unbounded preceding and 1 preceding)),
pl{i} as materialized (select bin_id, split from pl{i - 1} union all select bin_id, 'validation' from v{i} where val union all select bin_id, case when tes then 'test' else 'train' end from t{i})""")
    return ",\n".join(parts)


@query("p09_group_split", "v_samples", sql=split_sql("v_samples") + " select sample_id, split from sb join pl5 using (bin_id)")
def p09(v):
    return group_split(v)


PULLED = "pulled as (select *, clip_id%50=7 or rec_time>(select max(rec_time)-interval 60 day from v_samples) as test from v_samples), kept as (select * from pulled where not test),\n"


@query("p11_full_split", "v_samples", sql=PULLED + split_sql("kept") + " select sample_id, split from sb join pl5 using (bin_id) union all select sample_id, 'test' from pulled where test")
def p11(v):
    after = v.agg((F.max("rec_time") - F.expr("interval 60 days")).alias("after"))
    dated = v.crossJoin(F.broadcast(after)).withColumn("pulled", (F.col("rec_time") > F.col("after")) | (F.col("clip_id") % 50 == 7))  # one row
    return group_split(dated.where("not pulled").drop("after", "pulled")).union(dated.where("pulled").select("sample_id", F.lit("test")))


@query("p10_bin_choice", "v_samples", sql="g as (select label, count(distinct station_id) as bins, count(distinct track_id) as tracks from v_samples group by label) select sample_id, case when label='5-LOW' or bins<4 or tracks<100 then 'c'||clip_id else 's'||station_id end as bin_id from v_samples join g using (label)")
def p10(v):
    return binned(v).select("sample_id", "bin_id")


@query("p12_equal_rates", "v_samples", sql=N + ", m as (select min(n) as m from c where label<>'1-URGENT'), r as (select sample_id, label, row_number() over (partition by label order by md5(concat_ws('|','p12',sample_id)), sample_id) as rn from v_samples) select sample_id, label from r, m where rn<=m or label='1-URGENT'")
def p12(v):
    least = counts(v.where("label <> '1-URGENT'")).agg(F.min("n").alias("m"))
    return s.ranked(v, ["label"], "p12", "sample_id").crossJoin(F.broadcast(least)).where("rn <= m or label = '1-URGENT'").select("sample_id", "label")


@query("p13_bin_weights", "v_samples", sql="select sample_id, round(1e0/count(*) over (partition by station_id), 6) as one, round(least(1e0, 5e2/count(*) over (partition by station_id)), 6) as capped from v_samples")
def p13(v):
    n = F.count(F.lit(1)).over(Window.partitionBy("station_id"))
    return v.select("sample_id", r6(1.0 / n).alias("one"), r6(F.least(F.lit(1.0), 500.0 / n)).alias("capped"))


@query("p14_label_cdf", "v_samples", sql="w as (select sample_id, label, (1+mass)*case label when '5-LOW' then 5e-1 else 1e0 end as w from v_samples) select sample_id, round(sum(w) over (partition by label order by sample_id rows between unbounded preceding and current row)/sum(w) over (partition by label), 6) as cdf from w")
def p14(v):
    w = v.withColumn("w", (1 + F.col("mass")) * F.when(F.col("label") == "5-LOW", 0.5).otherwise(1.0))
    running = Window.partitionBy("label").orderBy("sample_id").rowsBetween(Window.unboundedPreceding, 0)
    return w.select("sample_id", r6(F.sum("w").over(running) / F.sum("w").over(Window.partitionBy("label"))).alias("cdf"))


@query("j04_test_pull", "v_samples", sql="select sample_id, clip_id%50=7 or rec_time>(select max(rec_time)-interval 60 day from v_samples) as test from v_samples")
def j04(v):
    listed = v.where("clip_id % 50 = 7").select("clip_id").distinct().withColumn("listed", F.lit(True))
    after = v.agg((F.max("rec_time") - F.expr("interval 60 days")).alias("after"))
    return v.join(listed, "clip_id", "left").crossJoin(F.broadcast(after)).select("sample_id", (F.coalesce("listed", F.lit(False)) | (F.col("rec_time") > F.col("after"))).alias("test"))


@query("j15_label_indices", "v_samples", sql="m(label, idx) as (values ('1-URGENT',0),('2-HIGH',0),('3-MEDIUM',1)) select sample_id, coalesce(idx,-1) as idx from v_samples left join m using (label)")
def j15(v):
    m = v.sparkSession.createDataFrame([("1-URGENT", 0), ("2-HIGH", 0), ("3-MEDIUM", 1)], "label string, idx int")
    return v.join(F.broadcast(m), "label", "left").select("sample_id", F.coalesce("idx", F.lit(-1)).alias("idx"))


@query("f15_unmapped_labels", "v_samples", sql="select sample_id from v_samples where label in ('1-URGENT','2-HIGH','3-MEDIUM')")
def f15(v):
    return j15(v).where("idx >= 0").select("sample_id")


@query("u01_leakage", "v_samples", sql=f"s as (select *, {SPLIT} from v_samples), b as (select distinct split, clip_id as bin_id from s) select bin_id from b group by bin_id having count(*)>1")
def u01(v):
    b = split(v).select("split", F.col("clip_id").alias("bin_id")).distinct()
    parts = [b.where(F.col("split") == n).select("bin_id") for n in ("train", "validation", "test")]
    return parts[0].intersect(parts[1]).union(parts[0].intersect(parts[2])).union(parts[1].intersect(parts[2])).distinct()


@query("u02_label_union", "v_samples", sql="select distinct label from (select label from v_samples union all select original_label from v_samples)")
def u02(v):
    return v.select("label").union(v.select("original_label")).distinct()


@query("u04_active_tracks", "v_regions", sql="select track_id, frame_number=49 as active from v_regions where frame_number=48 or (frame_number=49 and track_id%2=0) qualify row_number() over (partition by track_id order by frame_number desc)=1")
def u04(v):
    before = v.where("frame_number = 48").select("track_id")
    now = v.where("frame_number = 49 and track_id % 2 = 0").select("track_id")
    return before.exceptAll(now).select("track_id", F.lit(False).alias("active")).union(now.select("track_id", F.lit(True)))


@query("u05_remaining_labels", "v_samples", sql="select array_to_string(list_sort(list(distinct label)), ',') as labels from v_samples where label not in ('5-LOW','9-X')")
def u05(v):
    every = v.agg(F.collect_set("label").alias("l"))
    return every.select(F.array_join(F.array_sort(F.array_except("l", F.array(F.lit("5-LOW"), F.lit("9-X")))), ",").alias("labels"))


@query("k12_label_order", "v_samples", sql=N + " select label, row_number() over (order by case label when '2-HIGH' then 0 when '1-URGENT' then 2 else 1 end, n, label) as place from c")
def k12(v):
    return label_order(counts(v))


@query("s07_split_file", "v_samples", sql="f as (select distinct source_file, case when clip_id%10<7 then 'train' when clip_id%10<9 then 'validation' else 'test' end as split from v_samples where clip_id%11<>0) select sample_id, f.split from v_samples left join f using (source_file)")
def s07(v):
    m = F.col("clip_id") % 10
    listed = v.where("clip_id % 11 <> 0").select("source_file", F.when(m < 7, "train").when(m < 9, "validation").otherwise("test").alias("split")).distinct()
    return v.join(listed, "source_file", "left").select("sample_id", "split")


@query("s08_split_dump", "v_samples", sql=f"s as (select *, {SPLIT} from v_samples) select split, source_file, min(clip_id) as clip_id, min(station_id) as station_id, array_to_string(list_sort(list(distinct label)), ',') as tags from s group by split, source_file")
def s08(v):
    return split(v).groupBy("split", "source_file").agg(F.min("clip_id").alias("clip_id"), F.min("station_id").alias("station_id"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("tags"))


@query("s10_manifest", "v_samples", sql=f"s as (select *, {SPLIT} from v_samples) select label, count(*) filter (where split='train') as train, count(*) filter (where split='validation') as validation, count(*) filter (where split='test') as test from s group by label")
def s10(v):
    return split(v).groupBy("label").pivot("split", ["train", "validation", "test"]).agg(F.count(F.lit(1))).fillna(0)
