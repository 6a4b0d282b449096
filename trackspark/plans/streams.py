"""t01-t18 batch twins, j08, j10 greedy, j16, p02, w09 greedy: sequential steps and stream windows.

The streaming forms are in ``trackspark.streaming``; tests hold both against each other."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackspark.functions import geometry as g
from trackspark.operators import pixels as px
from trackspark.operators import recorder, tracker, tracks
from trackspark.streaming import cameras

from .base import query, r6
from .evaluation import j10
from .samples import usable, w09

CAM = "(partition by camera order by ts, event_id"
#: The cameras of the fixture send a frame every few minutes.
RECORDING = recorder.Recording(fps=1, preview_secs=5, min_secs=4, max_secs=40, idle_secs=7200)


def order() -> Window:
    return Window.partitionBy("camera").orderBy("ts", "event_id")



def numbered(v):
    """Regions that were seen, as untracked detections."""
    seen = tracks.with_border(v, g.fixed(1, 1, 158, 118)).where("not blank")
    return seen.select("clip_id", "frame_number", F.col("track_id").alias("region_id"), "x", "y", "width", "height", "mass", "pixel_variance", "along_border")


def detections(v):
    """Frames in which any region comes from a calibration are calibrating."""
    ffc = v.groupBy("clip_id", "frame_number").agg(F.max("ffc").alias("calibrating"))
    return numbered(v).join(ffc, ["clip_id", "frame_number"])


@query("j08_greedy_assignment", "v_regions")
def j08(v):
    return tracker.assign(numbered(v)).where("not blank").select("clip_id", "frame_number", "region_id", "online_track", "created")


@query("t08_online_tracker", "v_regions")
def t08(v):
    steps = tracker.assign(detections(v))
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return steps.groupBy("clip_id", "online_track").agg(F.min("frame_number").alias("first"), F.max("frame_number").alias("last"), n(~F.col("blank"), "n"), n(F.col("blank"), "blanks"))


@query("j10_greedy_match", "v_expected", "v_tracks")
def j10_greedy(e, t):
    return tracker.match_expected(j10(e, t).join(e.select("expected_id", "start_s"), "expected_id"))


@query("j16_box_merge", "v_regions")
def j16(v):
    return tracker.merge_components(v, 10.0)


@query("p02_masked_segments", "v_regions")
def p02(v):
    return tracker.masked_segments(usable(v), 10, 2)


@query("w09_top_mass_segments", "v_regions")
def w09_greedy(v):
    return tracker.heaviest_windows(w09(v), 10)


@query("t01_ring_buffer", "v_stream", sql=f"select event_id, lag(event_id, 9) over {CAM}) as oldest, first_value(event_id) over (partition by camera, epoch order by ts, event_id rows between 9 preceding and current row) as oldest_since_ffc from (select *, sum(case when ffc then 1 else 0 end) over {CAM} rows between unbounded preceding and current row) as epoch from v_stream)")
def t01(s):
    epochs = s.withColumn("epoch", F.sum(F.col("ffc").cast("long")).over(order().rowsBetween(Window.unboundedPreceding, 0)))
    since = F.first("event_id").over(Window.partitionBy("camera", "epoch").orderBy("ts", "event_id").rowsBetween(-9, 0))
    return epochs.select("event_id", F.lag("event_id", 9).over(order()).alias("oldest"), since.alias("oldest_since_ffc"))


@query("t02_motion_detector", "v_stream", sql=f"""m as (select *, avg(changed) over {CAM} rows between 10 preceding and 1 preceding) as mean, row_number() over {CAM}) as n from v_stream),
h as (select *, coalesce(changed>mean+5, false) and not ffc and n>20 as hit from m), i as (select *, sum(case when hit then 0 else 1 end) over {CAM} rows between unbounded preceding and current row) as island from h)
select event_id, sum(case when hit then 1 else 0 end) over (partition by camera, island order by ts, event_id rows between unbounded preceding and current row)>=2 as detected from i""")
def t02(s):
    m = s.withColumn("mean", F.avg("changed").over(order().rowsBetween(-10, -1))).withColumn("n", F.row_number().over(order()))
    hit = F.coalesce(F.col("changed") > F.col("mean") + 5, F.lit(False)) & (F.col("n") > 20)
    return px.trigger_runs(m, hit, F.col("ffc"), "camera", "ts", "event_id").select("event_id", (F.col("run") >= 2).alias("detected"))


GAPS = f"""g as (select *, case when date_diff('millisecond', lag(ts) over {CAM}), ts)<600000 then 0 else 1 end as fresh from v_stream where motion), s as (select *, sum(fresh) over {CAM} rows between unbounded preceding and current row) as session from g),
ses as (select camera, session, min(ts) as first, max(ts) as last, count(*) as frames from s group by 1,2)
"""


@query("t04_recording_sessions", "v_stream", sql=GAPS + "select camera, first, last, frames from ses")
def t04(s):
    return cameras.gap_sessions(s.where("motion"), 600)


@query("t05_pre_roll", "v_stream", sql=GAPS + "select ses.camera, first, count(v.event_id) as preview from ses left join v_stream v on v.camera=ses.camera and v.ts>=first-interval 300 second and v.ts<first group by 1,2")
def t05(s):
    sessions = cameras.gap_sessions(s.where("motion"), 600).select("camera", "first")
    # frames and sessions meet in five-minute bins; a session looks into its own bin and the one before
    bins = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / 300)
    wanted = sessions.withColumn("bin", F.explode(F.array(bins("first") - 1, bins("first"))))
    frames = s.select("camera", "ts", "event_id", bins("ts").alias("bin"))
    near = (frames["ts"] >= F.col("first") - F.expr("interval 300 seconds")) & (frames["ts"] < F.col("first"))
    return wanted.join(frames, (wanted["camera"] == frames["camera"]) & (wanted["bin"] == frames["bin"]) & near, "left").groupBy(wanted["camera"], "first").agg(F.count("event_id").alias("preview"))


#: Frame by frame through each camera: what a recorder does with a frame follows from what it did with the one before.  Frames are
#: numbered; ``pv`` is how many of the last frames are still there for a pre-roll.
RECORDER = f"""g as (select *, row_number() over {CAM}) as n, coalesce(epoch_us(ts)-lag(epoch_us(ts)) over {CAM})>{RECORDING.idle_secs}*1000000::bigint, false) as gap from v_stream),
b as (select *, max(case when gap or n=1 then n end) over (partition by camera order by n) as since, lead(n) over (partition by camera order by n) is null as final from g),
k as (select *, least({RECORDING.preview}, n-since) as pv from b),
r(camera, n, start_n, frames, until, forced_start, forced_frames, stop, stop_start, stop_frames) as (
 select distinct camera, 0::bigint, null::bigint, 0::bigint, 0::bigint, null::bigint, 0::bigint, null::varchar, null::bigint, 0::bigint from k
 union all select camera, n, case when stop is null then s end, case when stop is null then f else 0 end, u, fs, ff, stop, s, f from (
  select *, case when s is null then null when not motion and f>=u then 'quiet' when f={RECORDING.most} then 'full' end as stop from (
   select *, case when s is not null and motion then f+{RECORDING.least} when s=n then {RECORDING.least} else until end as u from (
    select k.camera, k.n, k.motion, case when k.gap then r.start_n end as fs, case when k.gap then r.frames else 0 end as ff,
     case when r.start_n is not null and not k.gap then r.start_n when k.motion and not k.ffc then k.n end as s,
     case when r.start_n is not null and not k.gap then r.frames+1 when k.motion and not k.ffc then 1 else 0 end as f, case when k.gap then 0 else r.until end as until
    from r join k on k.camera=r.camera and k.n=r.n+1)))),
e as (select camera, stop_start as s, n as e, stop_frames as frames, stop as reason from r where stop is not null union all select camera, forced_start, n-1, forced_frames, 'idle' from r where forced_start is not null
 union all select r.camera, start_n, r.n, frames, 'idle' from r join k on k.camera=r.camera and k.n=r.n where final and start_n is not null),
rec as (select e.camera, a.event_id as start_event, z.event_id as end_event, e.s, e.frames, a.pv as preview, e.reason, e.reason<>'idle' or e.frames>{RECORDING.preview + RECORDING.least} as kept from e join k a on a.camera=e.camera and a.n=e.s join k z on z.camera=e.camera and z.n=e.e)
"""


@query("t04_recorder", "v_stream", sql=RECORDER + "select camera, start_event, end_event, frames, preview, reason, kept from rec")
def t04_recorder(s):
    """The recordings of each camera, with extension, greatest length and forced stop."""
    return recorder.recordings(s, RECORDING).withColumn("preview", F.size("preview").cast("long"))


@query("t05_recorder_preroll", "v_stream", sql=RECORDER + "select rec.camera, start_event, k.event_id from rec join k on k.camera=rec.camera and k.n>=rec.s-rec.preview and k.n<rec.s")
def t05_recorder(s):
    """The frames before each recording that go with it."""
    return recorder.recordings(s, RECORDING).select("camera", "start_event", F.explode("preview").alias("event_id"))


@query("t17_recorder_discarded", "v_stream", sql=RECORDER + "select camera, count(*) as recordings, count(*) filter (where not kept) as discarded, sum(frames) filter (where kept) as frames from rec group by camera")
def t17_recorder(s):
    """Recordings that were stopped by force before they had pre-roll and minimum, by camera."""
    kept = F.col("kept")
    return recorder.recordings(s, RECORDING).groupBy("camera").agg(F.count(F.lit(1)).alias("recordings"), F.count(F.when(~kept, 1)).alias("discarded"), F.sum(F.when(kept, F.col("frames"))).alias("frames"))


@query("t06_throttle", "v_stream")
def t06(s):
    return tracker.per_camera(s, "throttle")


@query("t07_window_gate", "v_stream", sql="select event_id from v_stream where hour(ts)>=18 or hour(ts)<7")
def t07(s):
    return s.where((F.hour("ts") >= 18) | (F.hour("ts") < 7)).select("event_id")


@query("t12_ir_hysteresis", "v_stream")
def t12(s):
    return tracker.per_camera(s, "ir")


@query("t13_simple_hysteresis", "v_stream")
def t13(s):
    return tracker.per_camera(s, "simple")


@query("t14_fixed_segments", "v_stream", sql="select camera, time_bucket(interval 1 hour, ts) as start, count(*) as frames from v_stream group by 1,2")
def t14(s):
    return s.groupBy("camera", F.window(F.col("ts").cast("timestamp"), "1 hour")["start"].cast("timestamp_ntz").alias("start")).agg(F.count(F.lit(1)).alias("frames"))


@query("t15_rolling_time", "v_stream", sql=f"select event_id, round(avg(changed) over {CAM} rows between 26 preceding and current row), 6) as mean from v_stream")
def t15(s):
    return s.select("event_id", r6(F.avg("changed").over(order().rowsBetween(-26, 0))).alias("mean"))


@query("t17_discard_short", "v_stream", sql=GAPS + "select camera, first from ses where frames>3")
def t17(s):
    return cameras.gap_sessions(s.where("motion"), 600).where("frames > 3").select("camera", "first")


@query("t18_skipped_frames", "v_stream", sql=f"select event_id, n from (select *, row_number() over {CAM}) as n from v_stream) where changed>0")
def t18(s):
    return s.withColumn("n", F.row_number().over(order()).cast("long")).where("changed > 0").select("event_id", "n")
