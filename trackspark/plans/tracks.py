"""w01-w07, w17, w19, a01-a08, a10, f04, f08-f12, j01, j02, j06, j07, j09, k03, x06, x19: tracks and their windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackspark.functions import geometry as g
from trackspark.operators import tracks as t

from .base import query, r6
from .geometry import KEY, inner, keyed, screen, zone_entry

W = "window w as (partition by track_id order by frame_number)"
MOVES = f"""m as (select *, x+width/2e0 as mx, y+height/2e0 as my, x<=1 or y<=1 or x+width>=158 or y+height>=118 as border from v_regions),
v as (select *, row_number() over w as n, coalesce(mx-lag(mx) over w, 0) as vx, coalesce(my-lag(my) over w, 0) as vy, lag(x) over w as px, lag(y) over w as py, lag(width) over w as pw, lag(height) over w as ph,
  lag(blank) over w as pblank, lag(border) over w as pborder, first_value(mx) over w as fx, first_value(my) over w as fy from m {W}),
q as (select *, n>1 and not blank and not pblank and ((x<>px and x+width<>px+pw) or (y<>py and y+height<>py+ph) or border) as moving,
  n>1 and not border and not pborder and abs(height-ph)>greatest(5e0, ph*3e-1) as by_h, n>1 and not border and not pborder and abs(pw-width)>greatest(5e0, pw*3e-1) as by_w from v),
s as (select clip_id, track_id, count(*) as frames, coalesce(sum(sqrt(vx*vx+vy*vy)) filter (where moving), 0) as movement, sqrt(coalesce(max((mx-fx)*(mx-fx)+(my-fy)*(my-fy)) filter (where moving), 0)) as max_offset,
  count(*) filter (where moving) as frames_moved, sum(abs(vx)+abs(vy)) filter (where not blank)/count(*) filter (where not blank) as average_velocity,
  sqrt(avg(pixel_variance) filter (where not blank and pixel_variance<>0)) as delta_std,
  count(*) filter (where (by_h and height>ph) or (by_w and not by_h and pw>width)) as jitter_bigger, count(*) filter (where (by_h and height<=ph) or (by_w and not by_h and pw<=width)) as jitter_smaller,
  count(*) filter (where blank) as blank_frames, avg(mass) filter (where not blank) as average_mass, quantile_cont(mass, 5e-1) filter (where not blank) as median_mass, stddev_pop(mass) filter (where not blank) as mass_std from q group by clip_id, track_id),
st as (select *, cast(round_even(1e2*(jitter_bigger+jitter_smaller)/frames, 0) as bigint) as region_jitter, cast(round_even(1e2*blank_frames/frames, 0) as bigint) as blank_percent from s),
stats as (select *, least(sqrt(movement)+max_offset, 100)+least(delta_std*25, 100)+(100-region_jitter)+(100-blank_percent) as score from st)
"""
MOVES_LAG = f"""l as (select *, x+width/2e0 as mx, y+height/2e0 as my, coalesce(x+width/2e0-lag(x+width/2e0) over w, 0) as vx, coalesce(y+height/2e0-lag(y+height/2e0) over w, 0) as vy, row_number() over w as n,
 x<=1 or y<=1 or x+width>=158 or y+height>=118 as border from v_regions {W})
"""


@query("w01_velocity", "v_regions", sql=MOVES_LAG + "select clip_id, track_id, frame_number, vx, vy from l")
def w01(v):
    return keyed(t.with_velocity(v), "vx", "vy")


MEANS = """b as (select track_id, frame_number, avg(width*height) over r as area, avg(mass) over r as m from v_regions where not blank window r as (partition by track_id order by frame_number rows between 4 preceding and current row)),
mn as (select v.*, coalesce(last_value(b.area ignore nulls) over f, 0) as average_area, coalesce(last_value(b.m ignore nulls) over f, 0) as average_mass from v_regions v left join b on v.track_id=b.track_id and v.frame_number=b.frame_number
 window f as (partition by v.track_id order by v.frame_number rows between unbounded preceding and current row))
"""


@query("w02_recent_means", "v_regions", sql=MEANS + "select clip_id, track_id, frame_number, round(average_area, 6) as average_area, round(average_mass, 6) as average_mass from mn")
def w02(v):
    return keyed(t.recent_means(v), r6("average_area").alias("average_area"), r6("average_mass").alias("average_mass"))


SEEN = f"""n as (select *, row_number() over w as n, lag(blank) over w as pb from v_regions {W}),
o as (select *, n-coalesce(max(case when not blank then n end) over u, 0) as since_seen, sum(case when blank then 1 else 0 end) over u as blanks, sum(case when not blank and coalesce(pb,false) then 1 else 0 end) over u as run from n
 window u as (partition by track_id order by frame_number rows between unbounded preceding and current row)),
seen as (select *, sum(case when blank then 0 else 1 end) over (partition by track_id, run order by frame_number rows between unbounded preceding and current row) as clear_run, case when blank then since_seen<least(2*(n-since_seen), 18) else true end as tracking from o)
"""


@query("w03_visibility", "v_regions", sql=SEEN + "select clip_id, track_id, frame_number, cast(since_seen as bigint) as since_seen, cast(blanks as bigint) as blanks, cast(clear_run as bigint) as clear_run from seen")
def w03(v):
    return keyed(t.with_visibility(v), F.col("since_seen").cast("long").alias("since_seen"), "blanks", "clear_run")


@query("w04_tracking_alive", "v_regions", sql=SEEN + "select clip_id, track_id, frame_number, tracking from seen")
def w04(v):
    return keyed(t.with_visibility(v), "tracking")


@query("w05_smooth", "v_regions", sql=f"""a as (select *, (coalesce(lag(width) over w,width)+width+coalesce(lead(width) over w,width))/3e0 as mw, (coalesce(lag(height) over w,height)+height+coalesce(lead(height) over w,height))/3e0 as mh from v_regions {W}),
b as (select clip_id, track_id, frame_number, cast(trunc(x+width/2e0-mw/2) as bigint) as x, cast(trunc(y+height/2e0-mh/2) as bigint) as y, cast(trunc(mw) as bigint) as width, cast(trunc(mh) as bigint) as height from a)
select clip_id, track_id, frame_number, l as x, u as y, r-l as width, d-u as height from (select *, least(160, greatest(x, 0)) as l, least(120, greatest(y, 0)) as u, greatest(0, least(x+width,160)) as r, greatest(0, least(y+height,120)) as d from b)""")
def w05(v):
    return keyed(t.smooth(v, screen()), "x", "y", "width", "height")


@query("w06_trim", "v_regions", sql="""m as (select track_id, greatest(2, quantile_cont(mass, 5e-1)*5e-3) as lim from v_regions group by track_id),
e as (select v.track_id, min(frame_number) as a, max(frame_number) as b from v_regions v join m using (track_id) where mass>lim group by v.track_id)
select v.clip_id, v.track_id, v.frame_number, v.mass from v_regions v join e using (track_id) where v.frame_number between a and b""")
def w06(v):
    return keyed(t.trim(v), "mass")


@query("w07_fill_gaps", "v_regions", sql="""k as (select * from v_regions where frame_number%7<>3),
n as (select *, lead(frame_number) over (partition by track_id order by frame_number) as nx from k),
s as (select *, unnest(range(frame_number, coalesce(nx, frame_number+1))) as f from n)
select clip_id, track_id, f as frame_number, x, y, width, height, case when f<>frame_number then 0 else mass end as mass, f<>frame_number or blank as blank from s""")
def w07(v):
    return keyed(t.fill_gaps(v.where("frame_number % 7 <> 3")), "x", "y", "width", "height", "mass", "blank")


@query("w17_zone_latch", "v_regions", sql="""z as (select *, x between 20 and 120 and y between 15 and 90 as inz from v_regions),
b as (select *, inz and coalesce(lag(inz) over (partition by track_id order by frame_number), false) as both_in from z)
select clip_id, track_id, frame_number, bool_or(both_in) over (partition by track_id order by frame_number rows between unbounded preceding and current row) as latched from b""")
def w17(v):
    inside = F.col("x").between(20, 120) & F.col("y").between(15, 90)
    both = v.withColumn("_both", inside & F.coalesce(F.lag(inside).over(t.ordered()), F.lit(False)))
    return keyed(both.withColumn("latched", F.max("_both").over(t.so_far())), "latched")


@query("w19_match_gates", "v_regions", sql=MEANS.rstrip() + ",\n" + MOVES_LAG.replace("from v_regions", "from mn").rstrip() + """,
e as (select *, lead(border) over (partition by track_id order by frame_number) as nb, abs(vx)+abs(vy) as sp from l)
select clip_id, track_id, frame_number, round(450+power(2*case when n=1 then 2e0 else vx end, 2)+power(2*case when n=1 then 2e0 else vy end, 2), 6) as max_distance,
 round(case when n>13.5 then greatest(20e0, average_mass*(55e-2+case when sp>5 then 1e-1 else 0 end)) end, 6) as max_mass_change,
 case when border or nb then 2e0*case when sp>10 then 3 else 1 end else case when n<5 then 2e0 else 15e-1 end*case when sp>10 then 2 else 1 end end as max_size_change from e""")
def w19(v):
    rows = t.match_gates(t.with_border(t.with_velocity(t.recent_means(v)), inner()))
    return keyed(rows, r6("max_distance").alias("max_distance"), r6("max_mass_change").alias("max_mass_change"), "max_size_change")


@query("a01_track_mass_stats", "v_regions", sql="""select clip_id, track_id, coalesce(cast(trunc(quantile_cont(mass, 25e-2)) as bigint),0) as lower_mass, coalesce(cast(trunc(quantile_cont(mass, 75e-2)) as bigint),0) as upper_mass,
 coalesce(cast(trunc(quantile_cont(mass, 5e-1)) as bigint),0) as median_mass, coalesce(cast(trunc(avg(mass)) as bigint),0) as mean_mass, sum(mass)=0 as no_mass from v_regions group by clip_id, track_id""")
def a01(v):
    whole = lambda c, n: F.coalesce(c.cast("long"), F.lit(0)).alias(n)
    q = lambda p: F.percentile("mass", F.lit(p))
    return v.groupBy("clip_id", "track_id").agg(whole(q(0.25), "lower_mass"), whole(q(0.75), "upper_mass"), whole(q(0.5), "median_mass"), whole(F.avg("mass"), "mean_mass"), (F.sum("mass") == 0).alias("no_mass"))


def _stat(name: str, *cols: str, rounded: tuple[str, ...] = ()):
    """Register one view of the movement statistics."""
    text = MOVES + "select clip_id, track_id, " + ", ".join([*cols, *(f"round({c}, 6) as {c}" for c in rounded)]) + " from stats"

    @query(name, "v_regions", sql=text)
    def stat(v):
        return t.movement_statistics(v, inner()).select("clip_id", "track_id", *[F.col(c).cast("long").alias(c) for c in cols], *[r6(c).alias(c) for c in rounded])


_stat("a02_movement", "frames_moved", rounded=("movement",))
_stat("a03_max_offset", rounded=("max_offset",))
_stat("a04_average_velocity", rounded=("average_velocity",))
_stat("a05_delta_std", rounded=("delta_std",))
_stat("a06_jitter", "jitter_bigger", "jitter_smaller", "region_jitter")
_stat("a07_tracking_score", "blank_percent", rounded=("score",))
_stat("a08_mass_statistics", rounded=("average_mass", "median_mass", "mass_std"))

LIMITS = dict(min_frames=55, min_offset=60.0, min_moving=20, max_blank=10, max_jitter=45, min_delta=2.0, max_delta=2.8, min_mass=45.0)
REASON = """case when frames<55 then 'too short' when max_offset<60 or frames_moved<20 then 'didn''t move' when blank_percent>10 then 'too many blanks' when region_jitter>45 then 'too jittery'
 when delta_std<2 then 'too static' when delta_std>28e-1 then 'too dynamic' when average_mass<45 then 'mass too small' end"""


@query("f08_track_quality_filter", "v_regions", sql=MOVES + f"select clip_id, track_id, frames, frames_moved, region_jitter, blank_percent, round(score, 6) as score, {REASON} as reason from stats")
def f08(v):
    stats = t.movement_statistics(v, inner())
    return stats.select("clip_id", "track_id", "frames", F.col("frames_moved").cast("long").alias("frames_moved"), "region_jitter", "blank_percent", r6("score").alias("score"), t.quality_reason(F.col("frames"), **LIMITS).alias("reason"))


@query("f09_short_or_still_filter", "v_regions", sql=MOVES + "select clip_id, track_id, case when frames<55 then 'too short' when max_offset<60 or frames_moved<20 then 'didn''t move' end as reason from stats")
def f09(v):
    c = F.col
    reason = F.when(c("frames") < 55, "too short").when((c("max_offset") < 60) | (c("frames_moved") < 20), "didn't move")
    return t.movement_statistics(v, inner()).select("clip_id", "track_id", reason.alias("reason"))


@query("k03_best_tracks", "v_regions", sql=MOVES + "select clip_id, track_id, rank from (select clip_id, track_id, row_number() over (partition by clip_id order by round(score, 6) desc, track_id) as rank from stats) where rank<=2")
def k03(v):
    rank = F.row_number().over(Window.partitionBy("clip_id").orderBy(r6("score").desc(), "track_id")).cast("long")
    return t.movement_statistics(v, inner()).select("clip_id", "track_id", rank.alias("rank")).where("rank <= 2")


@query("a10_movement_data", "v_regions", sql=MOVES_LAG + "select clip_id, track_id, frame_number, x as l, y as t, x+width as r, y+height as b, mass, vx, vy, round(vx/sqrt(cast(width*height as double)), 6) as ax, round(vy/sqrt(cast(width*height as double)), 6) as ay from l")
def a10(v):
    b = g.box()
    root = F.sqrt(b.area.cast("double"))
    return keyed(t.with_velocity(v), b.x.alias("l"), b.y.alias("t"), b.right.alias("r"), b.bottom.alias("b"), "mass", "vx", "vy", r6(F.col("vx") / root).alias("ax"), r6(F.col("vy") / root).alias("ay"))


@query("f04_usable_frames", "v_regions", sql="""h as (select *, sum(mass) over (partition by track_id)=0 as none from v_regions)
select clip_id, track_id, frame_number from h where (none or mass>0) and not ffc and not blank and width>0 and height>0 and (none or mass>=20)""")
def f04(v):
    none = F.sum("mass").over(t.by_track()) == 0
    usable = v.withColumn("_none", none).where((F.col("_none") | (F.col("mass") > 0)) & ~F.col("ffc") & ~F.col("blank") & (F.col("width") > 0) & (F.col("height") > 0) & (F.col("_none") | (F.col("mass") >= 20)))
    return keyed(usable)


@query("f10_region_noise", "v_regions", sql="select clip_id, track_id, frame_number, not (pixel_variance<3 and mass<40) as kept_before_match, pixel_variance<3 or mass<40 as blanked_after_match from v_regions")
def f10(v):
    thin, light = F.col("pixel_variance") < 3, F.col("mass") < 40
    return keyed(v, (~(thin & light)).alias("kept_before_match"), (thin | light).alias("blanked_after_match"))


@query("f11_crop_strategy", "v_regions", sql="""c as (select *, greatest(20, least(x+width,120))-least(120,greatest(x,20)) as cw, greatest(15, least(y+height,90))-least(90,greatest(y,15)) as ch, x<20 or y<15 or x+width>120 or y+height>90 as cut from v_regions)
select clip_id, track_id, frame_number, not ((width-cw)/cast(width as double)>25e-2 or (height-ch)/cast(height as double)>25e-2) as cautious, not cut as none, true as "all" from c""")
def f11(v):
    b, bounds = g.box(), g.fixed(20, 15, 100, 75)
    c = g.crop(b, bounds)
    cut = (c.x != b.x) | (c.y != b.y) | (c.w != b.w) | (c.h != b.h)
    return keyed(v, (~(((b.w - c.w) / b.w > 0.25) | ((b.h - c.h) / b.h > 0.25))).alias("cautious"), (~cut).alias("none"), F.lit(True).alias("all"))


@query("f12_minimum_size", "v_regions", sql="select clip_id, track_id, frame_number from v_regions where width>=4 and height>=4 and width*height>=40")
def f12(v):
    return keyed(v.where((F.col("width") >= 4) & (F.col("height") >= 4) & (g.box().area >= 40)))


@query("j01_region_frame_lookup", "v_regions", "v_pixels", sql="""f as (select distinct clip_id, frame_number, true as found from v_pixels)
select v.clip_id, v.track_id, v.frame_number, coalesce(f.found, false) as has_frame from v_regions v left join f on v.clip_id=f.clip_id and v.frame_number=f.frame_number""")
def j01(v, p):
    frames = p.select("clip_id", "frame_number", F.lit(True).alias("found")).distinct()
    return keyed(v.join(frames, ["clip_id", "frame_number"], "left"), F.coalesce("found", F.lit(False)).alias("has_frame"))


@query("j02_exclude_frames", "v_regions", sql="""bad as (select distinct track_id, frame_number from v_regions where ffc or frame_number%13=5)
select v.clip_id, v.track_id, v.frame_number from v_regions v where not exists (select 1 from bad b where b.track_id=v.track_id and b.frame_number=v.frame_number)""")
def j02(v):
    bad = v.where("ffc or frame_number % 13 = 5").select("track_id", "frame_number").distinct()
    return keyed(v.join(bad, ["track_id", "frame_number"], "left_anti"))


PAIR = "a.clip_id=b.clip_id and a.frame_number=b.frame_number and a.track_id<>b.track_id"
OVERLAP = "greatest(0, least(a.x+a.width,b.x+b.width)-greatest(a.x,b.x))*greatest(0, least(a.y+a.height,b.y+b.height)-greatest(a.y,b.y))"


def frame_pairs(v):
    """Regions of different tracks in the same frame, side by side (a_*, b_*)."""
    a = v.select(*[F.col(c).alias(c if c in ("clip_id", "frame_number") else f"a_{c}") for c in v.columns])
    b = v.select(*[F.col(c).alias(c if c in ("clip_id", "frame_number") else f"b_{c}") for c in v.columns])
    return a.join(b, ["clip_id", "frame_number"]).where("a_track_id <> b_track_id")


@query("j06_track_overlap_ratio", "v_regions", sql=f"""o as (select a.clip_id, a.track_id, b.track_id as other_id, count(*) filter (where {OVERLAP}/cast(a.width*a.height as double)>=5e-2) as k from v_regions a join v_regions b on {PAIR} group by a.clip_id, a.track_id, b.track_id),
n as (select track_id, count(*) as n from v_regions group by track_id)
select clip_id, o.track_id, other_id, round(k/cast(n as double), 6) as ratio from o join n on n.track_id=o.track_id""")
def j06(v):
    a, b = g.box("a_"), g.box("b_")
    hit = F.sum((g.overlap_area(a, b) / a.area >= 0.05).cast("long"))
    n = v.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = frame_pairs(v).groupBy("clip_id", F.col("a_track_id").alias("track_id"), F.col("b_track_id").alias("other_id")).agg(hit.alias("k"))
    return pairs.join(n, "track_id").select("clip_id", "track_id", "other_id", r6(F.col("k") / F.col("n")).alias("ratio"))


@query("j07_candidate_scores", "v_regions", sql=MEANS.rstrip() + ",\n" + MOVES_LAG.replace("from v_regions", "from mn").rstrip() + """,
e as (select *, abs(vx)+abs(vy) as sp, 450+power(2*case when n=1 then 2e0 else vx end, 2)+power(2*case when n=1 then 2e0 else vy end, 2) as most from l),
p as (select e.*, r.track_id as region_track, r.frame_number as later, (power(r.x-e.x,2)+power(r.y-e.y,2)+power(r.x+r.width-e.x-e.width,2)+power(r.y+r.height-e.y-e.height,2))/2 as score,
 abs(r.width*r.height-e.average_area)/(e.average_area+50) as size_change, abs(e.average_mass-r.mass) as mass_change, e.border or r.border as edge
 from e join l r on r.clip_id=e.clip_id and r.frame_number=e.frame_number+1 where not r.blank)
select clip_id, track_id, region_track, later as frame_number, round(score, 6) as score from p
where round(score, 6)<=round(most, 6) and (n<=13.5 or round(mass_change, 6)<=round(greatest(20e0, average_mass*(55e-2+case when sp>5 then 1e-1 else 0 end)), 6))
 and round(size_change, 6)<=case when edge then 2e0*case when sp>10 then 3 else 1 end else case when n<5 then 2e0 else 15e-1 end*case when sp>10 then 2 else 1 end end""")
def j07(v):
    gates = t.match_gates(t.with_border(t.with_velocity(t.recent_means(v)), inner()))
    return t.match_candidates(gates).withColumn("score", r6("score"))


@query("j09_new_track_suppression", "v_regions", sql=f"""select a.clip_id, a.track_id, a.frame_number from v_regions a where not exists (select 1 from v_regions b where a.clip_id=b.clip_id and a.frame_number=b.frame_number and b.track_id<a.track_id and {OVERLAP}>25e-2*a.width*a.height)""")
def j09(v):
    a, b = g.box("a_"), g.box("b_")
    covered = frame_pairs(v).where((F.col("b_track_id") < F.col("a_track_id")) & (g.overlap_area(a, b) > 0.25 * a.area)).select("clip_id", F.col("a_track_id").alias("track_id"), "frame_number").distinct()
    return keyed(v.join(covered, list(KEY), "left_anti"))


@query("x06_track_seconds", "v_tracks", sql="select clip_id, track_id, round(start_frame/9e0, 6) as start_s, round((end_frame+1)/9e0, 6) as end_s from v_tracks")
def x06(v):
    return v.select("clip_id", "track_id", r6(F.col("start_frame") / 9.0).alias("start_s"), r6((F.col("end_frame") + 1) / 9.0).alias("end_s"))


@query("x19_segment_weight", "v_regions", sql="select track_id, cast(floor(frame_number/25) as bigint) as segment, case when avg(mass)<50 then 75e-2 when avg(mass)<100 then 1e0 else 12e-1 end as weight from v_regions group by 1, 2")
def x19(v):
    m = F.avg("mass")
    return v.groupBy("track_id", F.floor(F.col("frame_number") / 25).alias("segment")).agg(F.when(m < 50, 0.75).when(m < 100, 1.0).otherwise(1.2).alias("weight"))


__all__ = ["zone_entry"]
