"""f01-f03, f05, f07, f17, k01, k02, x01-x05, x07, x08, x17, x20, j03, j05, j13, j17, a13, s05, s06, s11-s15, s19-s21: clips and tags."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackspark.operators import tags as t
from trackspark.sources import documents as d
from trackspark.sources.store import BOX, TrackStore

from .base import query, r6

BOUNDS = (120.0, -40.0, 175.0, -8.0)
AFTER = "2024-01-01 06:00:00"
CLIP_REASON = """case when contains(lower(event), 'trap') then 'trap' when not (lng between 120 and 175 and lat between -40 and -8) then 'location' when rec_time<=(select min(ts)+interval 2 hour from events) then 'date' end"""
REGROUP = """case when what in ('pukeko','duck') then what when len(p)=1 then what when path like 'all.mammal%' then case when len(p)=4 then p[-2] else what end
 when p[-2]='kiwi' or p[-1]='kiwi' then 'kiwi' when p[-2]='other' then what when contains(path,'bird.') then 'bird' when len(p)>2 then p[-3] else p[-1] end"""


def early(e):
    """The first two hours of the events, as one row."""
    return e.agg((F.min("ts") + F.expr("interval 2 hours")).alias("after"))


@query("f01_clip_filter", "v_clips", "events", sql=f"select clip_id, {CLIP_REASON} as reason from v_clips")
def f01(c, e):
    return c.crossJoin(F.broadcast(early(e))).select("clip_id", t.clip_reason(BOUNDS, F.col("after")).alias("reason"))


TRACKS = """h as (select track_id, min(what) as label, list(distinct what) as human_tags, max(confidence) as confidence from v_tags where not automatic group by track_id),
k as (select v.track_id, v.num_regions as n_regions, h.label, h.human_tags, h.confidence from v_tracks v left join h using (track_id)),
r as (select track_id, human_tags, case when label is null then 'notags' when label='rat' or list_has_any(human_tags, ['rat']) then 'tags' when n_regions=0 then 'no_data' when confidence<=9e-1 then 'confidence' end as reason from k)
"""


def labelled(tags, tracks):
    human = tags.where(~F.col("automatic")).groupBy("track_id").agg(F.min("what").alias("label"), F.collect_set("what").alias("human_tags"), F.max("confidence").alias("confidence"))
    return tracks.join(human, "track_id", "left").withColumn("n_regions", F.col("num_regions"))


@query("f02_track_filter", "v_tags", "v_tracks", sql=TRACKS + "select track_id, reason from r")
def f02(g, v):
    return labelled(g, v).select("track_id", t.track_reason(["rat"], 0.9).alias("reason"))


@query("f03_filter_tally", "v_tags", "v_tracks", sql=TRACKS + "select coalesce(reason,'kept') as reason, count(*) as n, coalesce(array_to_string(list_sort(list_distinct(flatten(list(case when reason='tags' then list_filter(human_tags, lambda x: x='rat') else [] end)))), ','), '') as names from r group by 1")
def f03(g, v):
    rows = labelled(g, v).withColumn("reason", F.coalesce(t.track_reason(["rat"], 0.9), F.lit("kept")))
    names = F.when(F.col("reason") == "tags", F.filter("human_tags", lambda x: x == "rat")).otherwise(F.array().cast("array<string>"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(names)))), ",").alias("names"))


@query("f05_ffc_frames", "v_stream", sql="select event_id, changed%5 in (1,2) or date_diff('millisecond', last_value(case when ffc then ts end ignore nulls) over (partition by camera order by ts, event_id rows between unbounded preceding and current row), ts)/1e3 < 99e-1*60 as affected from v_stream")
def f05(s):
    last = F.last(F.when(F.col("ffc"), F.col("ts")), ignorenulls=True).over(Window.partitionBy("camera").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    ms = F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(last.cast("timestamp"))
    return s.select("event_id", ((F.col("changed") % 5).isin(1, 2) | (ms / 1e3 < 9.9 * 60)).alias("affected"))


@query("f07_fp_frames", "v_predictions", sql="""m as (select *, row_number() over (partition by vec_id order by score desc, idx) as r from v_predictions)
select distinct track_id, vec_id from v_predictions where vec_id not in (select vec_id from m where r=1 and idx=3 and score>25e-2)""")
def f07(p):
    top = p.withColumn("r", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "idx"))).where("r = 1 and idx = 3 and score > 0.25")
    return p.select("track_id", "vec_id").distinct().join(top.select("vec_id"), "vec_id", "left_anti")


@query("f17_active_tracks", "v_regions", sql="""a as (select clip_id, track_id, count(*) as n, arg_max(mass, frame_number) as mass from v_regions group by clip_id, track_id)
select clip_id, track_id, n>=8 as ready, n>10 and mass>16 as big from a""")
def f17(v):
    return v.groupBy("clip_id", "track_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("mass", "frame_number").alias("mass")).select("clip_id", "track_id", (F.col("n") >= 8).alias("ready"), ((F.col("n") > 10) & (F.col("mass") > 16)).alias("big"))


BEST = """h as (select *, round(case what when 'rat' then 1 when 'kiwi' then 2 else 100 end+(1-confidence), 9) as ranking from v_tags where not automatic and confidence>=55e-2),
b as (select *, min(ranking) over (partition by track_id) as best from h),
top as (select * from b where ranking=best),
d as (select track_id, what, path, row_number() over (partition by track_id order by length(path) desc, tag_id) as r from top),
c as (select d.track_id, d.what, d.path, bool_or(d.what<>top.what and not (contains(d.path, top.path) or contains(top.path, d.path))) as clash from d join top on d.track_id=top.track_id where d.r=1 group by 1,2,3)
"""


@query("k01_best_human_tag", "v_tags", sql=BEST + "select track_id, case when not clash then what end as what, case when not clash then path end as path from c")
def k01(g):
    ranks = g.sparkSession.sql("select * from values ('rat', 1.0D), ('kiwi', 2.0D) as t(what, rank)")
    return t.best_human_tag(g, ranks, 100.0, 0.55)


@query("k02_best_test_tag", "v_tags", sql="select track_id, what from (select track_id, what, row_number() over (partition by track_id order by automatic, confidence desc, what='rodent' desc, tag_id) as r from v_tags) where r=1")
def k02(g):
    r = F.row_number().over(Window.partitionBy("track_id").orderBy("automatic", F.desc("confidence"), (F.col("what") == "rodent").desc(), "tag_id"))
    return g.withColumn("r", r).where("r = 1").select("track_id", "what")


@query("x01_regroup", "v_tags", sql=f"""d as (select distinct what, path from v_tags), e as (select *, string_split(path,'.') as p from d)
select what, path, {REGROUP} as grp from e""")
def x01(g):
    return g.select("what", "path").distinct().select("what", "path", t.regrouped(F.col("what"), F.col("path")).alias("grp"))


@query("x02_conflicting_tags", "v_tags", sql="d as (select distinct what, path from v_tags) select a.what as a, b.what as b, a.what<>b.what and not (contains(a.path,b.path) or contains(b.path,a.path)) as conflict from d a, d b")
def x02(g):
    d = g.select("what", "path").distinct()  # one row per label
    a, b = d.toDF("a", "pa"), d.toDF("b", "pb")
    return a.crossJoin(F.broadcast(b)).select("a", "b", t.conflicting(F.col("a"), F.col("pa"), F.col("b"), F.col("pb")).alias("conflict"))


@query("x03_keys", "v_regions", sql="select concat_ws('-', clip_id, track_id) as track_key, concat_ws('-', clip_id, track_id, frame_number) as frame_key, concat_ws('-', clip_id, cast(floor(frame_number/20) as bigint)) as bin_key from v_regions")
def x03(v):
    return v.select(F.concat_ws("-", "clip_id", "track_id").alias("track_key"), F.concat_ws("-", "clip_id", "track_id", "frame_number").alias("frame_key"), F.concat_ws("-", "clip_id", F.floor(F.col("frame_number") / 20)).alias("bin_key"))


@query("x04_durations", "v_clips", sql="""d as (select clip_id, case clip_id%7 when 0 then '30m' when 1 then '30s' when 2 then '1.5h' when 3 then '3.5' when 4 then '3.5z' when 5 then '1a.d5h' else ' 17 ' end as txt from v_clips)
select clip_id, txt, try_cast(regexp_replace(trim(txt), '[A-Za-z]$', '') as double)*case regexp_extract(trim(txt), '([A-Za-z])$', 1) when '' then 60 when 'm' then 60 when 'h' then 3600 else 1 end as seconds from d""")
def x04(c):
    txt = F.element_at(F.array(*map(F.lit, ("30m", "30s", "1.5h", "3.5", "3.5z", "1a.d5h", " 17 "))), (F.col("clip_id") % 7 + 1).cast("int"))
    return c.select("clip_id", txt.alias("txt")).withColumn("seconds", t.duration_seconds(F.col("txt")))


@query("x05_local_time", "v_clips", sql="select clip_id, rec_time+interval 12 hour as local_time, hour(rec_time+interval 12 hour)>=2 as night from v_clips")
def x05(c):
    local = F.col("rec_time") + F.expr("interval 12 hours")
    return c.select("clip_id", local.alias("local_time"), (F.hour(local) >= 2).alias("night"))


SECONDS = "hour(rec_time)*3600+minute(rec_time)*60+second(rec_time)"


@query("x07_recording_window", "v_clips", sql=f"""s as (select clip_id, {SECONDS} as now, (clip_id%24)*3600 as a, ((clip_id*5)%24)*3600 as b from v_clips)
select clip_id, case when a=b then true when a<b then now>=a and now<b else now>=a or now<b end as inside from s""")
def x07(c):
    now = F.hour("rec_time") * 3600 + F.minute("rec_time") * 60 + F.second("rec_time")
    return c.select("clip_id", t.inside_window(now, (F.col("clip_id") % 24) * 3600, ((F.col("clip_id") * 5) % 24) * 3600).alias("inside"))


SUN = """d as (select clip_id, dayofyear(rec_time) as d, lat, lng, pi()/180 as r from v_clips),
e as (select *, -23.44*cos(r*(3.6e2/365e0)*(d+10)) as dec, r*(3.6e2/365e0)*(d-81) as b from d),
f as (select *, acos(greatest(-1e0, least(1e0, -tan(lat*r)*tan(dec*r))))/r/15e0 as half, 12e0-lng/15e0-(9.87*sin(2*b)-7.53*cos(b)-15e-1*sin(b))/6e1 as noon from e)
"""


@query("x08_sun_window", "v_clips", sql=SUN + "select clip_id, round(noon-half, 6) as sunrise, round(noon+half, 6) as sunset from f")
def x08(c):
    rise, fall = t.sun_times(F.dayofyear("rec_time"), F.col("lat"), F.col("lng"))
    return c.select("clip_id", r6(rise).alias("sunrise"), r6(fall).alias("sunset"))


@query("x20_default_location", "v_clips", sql="select clip_id, case when clip_id%5=0 or lat is null then -43.5321e0 else lat end as lat, case when clip_id%5=0 or lng is null then 172.6362e0 else lng end as lng from v_clips")
def x20(c):
    missing = lambda n: (F.col("clip_id") % 5 == 0) | F.col(n).isNull()
    return c.select("clip_id", F.when(missing("lat"), -43.5321).otherwise(F.col("lat")).alias("lat"), F.when(missing("lng"), 172.6362).otherwise(F.col("lng")).alias("lng"))


@query("j03_label_remap", "v_tags", sql="select tag_id, coalesce(m.b, what) as label from v_tags left join (values ('rat','rodent'),('kiwi','bird')) m(a,b) on what=m.a")
def j03(g):
    remap = g.sparkSession.sql("select * from values ('rat', 'rodent'), ('kiwi', 'bird') as m(what, to)")
    return g.join(F.broadcast(remap), "what", "left").select("tag_id", F.coalesce("to", "what").alias("label"))


@query("j05_country", "v_clips", sql="select clip_id, case when lng between 113 and 154 and lat between -44 and -10 then 'AU' when lng between 166 and 179 and lat between -48 and -34 then 'NZ' end as country from v_clips")
def j05(c):
    boxes = c.sparkSession.sql("select * from values (1, 'AU', 113D, 154D, -44D, -10D), (2, 'NZ', 166D, 179D, -48D, -34D) as b(ord, country, west, east, south, north)")
    hits = c.join(F.broadcast(boxes), F.col("lng").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north")), "left")
    return hits.groupBy("clip_id").agg(F.min_by("country", "ord").alias("country"))


@query("j13_camera_thresholds", "v_clips", sql="""m as (select *, case when device_id<4 then 'lepton'||device_id end as model from v_clips), d(model, temp, def) as (values ('lepton0', 2700, false), ('lepton2', 2800, false), ('any', 2900, true))
select clip_id, coalesce(x.temp, (select temp from d where def)) as temp from m left join d x on m.model=x.model and not x.def""")
def j13(c):
    rows = c.sparkSession.sql("select * from values ('lepton0', 2700, false), ('lepton2', 2800, false), ('any', 2900, true) as d(model, temp, def)")
    named = c.withColumn("model", F.when(F.col("device_id") < 4, F.concat(F.lit("lepton"), F.col("device_id"))))
    default = rows.where("def").select(F.col("temp").alias("usual"))
    return named.join(F.broadcast(rows.where("not def")), "model", "left").crossJoin(F.broadcast(default)).select("clip_id", F.coalesce("temp", "usual").alias("temp"))


@query("j17_country_model", "v_clips", sql="""c as (select clip_id, case when lng between 113 and 154 and lat between -44 and -10 then 'AU' when lng between 166 and 179 and lat between -48 and -34 then 'NZ' end as country, 'm'||(clip_id%2) as model from v_clips)
select clip_id, coalesce(o.file, c.model||'.bin') as file from c left join (values ('m0','AU','m0-au.bin')) o(model, country, file) on c.model=o.model and c.country=o.country""")
def j17(c):
    named = j05(c).withColumn("model", F.concat(F.lit("m"), F.col("clip_id") % 2))
    own = c.sparkSession.sql("select * from values ('m0', 'AU', 'm0-au.bin') as o(model, country, file)")
    return named.join(F.broadcast(own), ["model", "country"], "left").select("clip_id", F.coalesce("file", F.concat("model", F.lit(".bin"))).alias("file"))


@query("a13_clip_primary_tag", "v_tags", "v_tracks", sql="""h as (select clip_id, list(distinct what) as w from v_tracks left join (select * from v_tags where not automatic) g using (track_id) group by clip_id)
select clip_id, case len(list_filter(w, lambda x: x is not null)) when 0 then 'no tag' when 1 then list_filter(w, lambda x: x is not null)[1] else 'multi' end as tag from h""")
def a13(g, v):
    human = g.where("not automatic").select("track_id", "what")
    found = v.join(human, "track_id", "left").groupBy("clip_id").agg(F.collect_set("what").alias("w"))
    return found.select("clip_id", F.when(F.size("w") == 0, "no tag").when(F.size("w") == 1, F.element_at("w", 1)).otherwise("multi").alias("tag"))


@query("s05_ban_list", "v_clips", sql="select clip_id from v_clips where clip_id not in (select clip_id from v_clips where clip_id%6=1)")
def s05(c):
    return c.select("clip_id").join(c.where("clip_id % 6 = 1").select("clip_id"), "clip_id", "left_anti")


@query("s06_ignore_list", "v_tracks", sql="""i as (select '['||string_agg(clip_id||'-'||track_id, ', ' order by track_id)||']' as line from v_tracks where track_id%4=0)
select clip_id, track_id from v_tracks where clip_id||'-'||track_id not in (select unnest(regexp_extract_all(line, '[0-9]+-[0-9]+')) from i)""")
def s06(v):
    # a line of the ignore file
    line = v.where("track_id % 4 = 0").groupBy("clip_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.concat_ws("-", "clip_id", "track_id")), ", "), F.lit("]")).alias("line"))
    ignored = line.select(F.explode(F.regexp_extract_all("line", F.lit("[0-9]+-[0-9]+"), F.lit(0))).alias("key"))
    return v.withColumn("key", F.concat_ws("-", "clip_id", "track_id")).join(ignored, "key", "left_anti").select("clip_id", "track_id")


@query("s11_finished_clips", "v_clips", "events", sql="select clip_id from v_clips where rec_time<(select max(rec_time) from v_clips) and rec_time>=(select min(ts)+interval 2 hour from events)")
def s11(c, e):
    limits = early(e).crossJoin(c.agg(F.max("rec_time").alias("before")))
    return c.crossJoin(F.broadcast(limits)).where("rec_time < before and rec_time >= after").select("clip_id")


@query("s12_track_slice", "v_regions", sql="select track_id, frame_number, mass from v_regions where track_id%10=1 and (frame_number>=5 and frame_number<15 or frame_number in (20,22))")
def s12(v):
    return v.where((F.col("track_id") % 10 == 1) & (((F.col("frame_number") >= 5) & (F.col("frame_number") < 15)) | F.col("frame_number").isin(20, 22))).select("track_id", "frame_number", "mass")


def stored(v):
    """A track store of a table of regions, in a new folder."""
    return TrackStore(v.sparkSession, d.shared_folder(v.sparkSession, "store"), 16).create(v)


def gone_tracks(v):
    """Tracks 3 and 7, one that is not in its clip, and one of a clip that is not in the store."""
    own = v.where("track_id in (3, 7)").select("clip_id", "track_id")
    return own.unionByName(v.where("clip_id = 1").select("clip_id", F.lit(-1).cast("long").alias("track_id"))).unionByName(own.select(F.lit(-5).cast("long").alias("clip_id"), "track_id")).distinct()


@query("s13_delete_track", "v_regions", sql="select clip_id, track_id, frame_number from v_regions where not (track_id in (3, 7)) and clip_id<>5")
def s13(v):
    """What a store holds when tracks, and a clip, are gone; only their partitions are rewritten."""
    store = stored(v)
    store.remove_tracks(gone_tracks(v))
    store.remove_clips(v.sparkSession.createDataFrame([(5,)], "clip_id long"))
    return store.table("regions").select("clip_id", "track_id", "frame_number")


@query("s13_delete_found", "v_regions", sql="""k as (select distinct clip_id, track_id from v_regions where track_id in (3, 7) union select distinct clip_id, -1 from v_regions where clip_id=1 union select distinct -5, track_id from v_regions where track_id in (3, 7))
select clip_id, track_id, clip_id in (select clip_id from v_regions) as found, (clip_id, track_id) in (select (clip_id, track_id) from v_regions) as removed from k""")
def s13_found(v):
    """What the deletion tells of each key: whether the clip was found, and whether there was such a track."""
    return stored(v).remove_tracks(gone_tracks(v))


def tag_updates(v, every, seq):
    """Tags of every so many frames of all tracks; a third of the tracks gets no tag of its own."""
    picked = v.where(f"frame_number % {every} = 0")
    tag = F.when(F.col("clip_id") % 2 == 0, "possum").otherwise("rat")
    track_tag = F.when(F.col("track_id") % 3 == 0, F.lit(None).cast("string")).when(F.col("track_id") % 3 == 1, "rat").otherwise("possum")
    return picked.select(F.lit(seq).cast("long").alias("seq"), "clip_id", "track_id", tag.alias("clip_tag"), track_tag.alias("track_tag"), "frame_number", *(F.col(c).cast("boolean" if c == "blank" else "long").alias(c) for c in BOX))


@query("s14_upsert_tag_frames", "v_regions", sql="""a as (select *, case when clip_id%2=0 then 'possum' else 'rat' end as tag, case track_id%3 when 1 then 'rat' when 2 then 'possum' end as own from v_regions where frame_number%3=0 or frame_number%4=0),
f as (select clip_id, tag, array_to_string(list_sort(list(distinct frame_number)), ',') as frames from a group by 1,2),
r as (select clip_id, tag, count(*) as regions, sum(mass) as mass from (select distinct clip_id, tag, frame_number, x, y, width, height, mass, blank from a where tag=own and not blank) group by 1,2)
select clip_id, tag, frames, coalesce(regions, 0) as regions, coalesce(mass, 0) as mass from f left join r using (clip_id, tag)""")
def s14(v):
    """Two rounds of human tags put into a store; the second finds some of its frames and regions there."""
    store = stored(v)
    store.update_tags(tag_updates(v, 3, 1))
    store.update_tags(tag_updates(v, 4, 2))
    frames = store.table("tag_frames").groupBy("clip_id", "tag").agg(F.array_join(F.array_sort(F.collect_list("frame_number")).cast("array<string>"), ",").alias("frames"))
    regions = store.table("tag_regions").groupBy("clip_id", "tag").agg(F.count(F.lit(1)).alias("regions"), F.sum("mass").alias("mass"))
    return frames.join(regions, ["clip_id", "tag"], "left").select("clip_id", "tag", "frames", F.coalesce("regions", F.lit(0)).alias("regions"), F.coalesce("mass", F.lit(0)).alias("mass"))


@query("s14_tagged_tracks", "v_regions", sql="""t as (select distinct clip_id, track_id, max(case when frame_number%4=0 or frame_number%3=0 then 1 end) over (partition by clip_id, track_id) as hit from v_regions)
select track_id, case when hit=1 then case track_id%3 when 1 then 'rat' when 2 then 'possum' end end as tag, coalesce(hit=1 and track_id%3<>0, false) as tag_confirmed from t""")
def s14_tracks(v):
    """The tracks of the same store: their own tags, and whether they are confirmed."""
    store = stored(v)
    store.update_tags(tag_updates(v, 3, 1).unionByName(tag_updates(v, 4, 2)))
    return store.table("tracks").select("track_id", "tag", "tag_confirmed")


@query("s15_next_clip_id", "v_clips", sql="select coalesce(max(clip_id)+1, 1) as next_id, max(rec_time) as latest from v_clips")
def s15(c):
    return c.agg(F.coalesce(F.max("clip_id") + 1, F.lit(1)).alias("next_id"), F.max("rec_time").alias("latest"))


@query("s19_tag_export", "v_tags", sql="""select track_id, max_by(what, confidence*1000000-tag_id/1e6) as main, count(*) as n_tags, array_to_string(list_sort(list_distinct(list(what))), '|') as tags from v_tags where not automatic group by track_id""")
def s19(g):
    return g.where("not automatic").groupBy("track_id").agg(F.max_by("what", F.col("confidence") * 1000000 - F.col("tag_id") / 1e6).alias("main"), F.count(F.lit(1)).alias("n_tags"), F.array_join(F.array_sort(F.collect_set("what")), "|").alias("tags"))


@query("s20_rolling_cutoff", "v_clips", sql="""f as (select strftime(rec_time, '%Y%m%d-%H%M%S')||'.rec' as name from v_clips)
select max(strptime(regexp_extract(name, '([0-9]{8}-[0-9]{6})', 1), '%Y%m%d-%H%M%S'))-interval 180 day as cutoff from f""")
def s20(c):
    name = F.concat(F.date_format("rec_time", "yyyyMMdd-HHmmss"), F.lit(".rec"))
    when = F.to_timestamp(F.regexp_extract(name, r"([0-9]{8}-[0-9]{6})", 1), "yyyyMMdd-HHmmss").cast("timestamp_ntz")
    return c.select(when.alias("w")).agg((F.max("w") - F.expr("interval 180 days")).alias("cutoff"))


@query("s21_retention", "v_clips", sql="""b as (select clip_id, rec_time, 100+clip_id%50 as bytes from v_clips), r as (select *, sum(bytes) over (order by rec_time desc, clip_id desc rows between unbounded preceding and current row) as used from b)
select clip_id from r where used<=(select 7e-1*sum(bytes) from b)""")
def s21(c):
    """Newest recordings first, until their bytes fill 0.7 of the whole.  Running totals are taken within days, on top of
    those of all later days: a window over all rows would be one task."""
    sized = c.select("clip_id", "rec_time", F.to_date("rec_time").alias("day"), (100 + F.col("clip_id") % 50).alias("bytes"))
    days = sized.groupBy("day").agg(F.sum("bytes").alias("bytes"))  # as many rows as days
    later = F.sum("bytes").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1))
    total = days.select("day", F.coalesce(later, F.lit(0)).alias("later"), (0.7 * F.sum("bytes").over(Window.partitionBy(F.lit(0)))).alias("budget"))
    within = F.sum("bytes").over(Window.partitionBy("day").orderBy(F.desc("rec_time"), F.desc("clip_id")).rowsBetween(Window.unboundedPreceding, 0))
    return sized.join(total, "day").withColumn("used", F.col("later") + within).where("used <= budget").select("clip_id")


@query("x17_score_map", "v_predictions", sql="select vec_id, round(max(score) filter (where idx=2), 6) as two, coalesce(round(max(score) filter (where idx=77), 6), 0) as absent from v_predictions group by vec_id")
def x17(p):
    m = p.groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("idx"), F.col("score")))).alias("m"))
    return m.select("vec_id", r6(F.try_element_at("m", F.lit(2).cast("long"))).alias("two"), F.coalesce(r6(F.try_element_at("m", F.lit(77).cast("long"))), F.lit(0.0)).alias("absent"))
