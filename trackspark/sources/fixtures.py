"""Views that give the driver's tables the shape of the track tables.

Each view is text that is valid in Spark and in the other engine; two differ in how arrays unroll.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "labels")

#: name -> (what it reads, text for Spark, text for the other engine where it differs)
VIEWS: dict[str, tuple[tuple[str, ...], str, str | None]] = {
    "v_regions": (("events",), """
select cast(floor(user_id/3) as bigint) as clip_id, user_id as track_id,
  cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as frame_number,
  (event_id*37)%140 as x, (event_id*53)%100 as y, 1+(event_id*7)%20 as width, 1+(event_id*11)%20 as height,
  case when event_id%11=0 then 0 else cast(floor(value) as bigint) end as mass,
  event_id%11=0 as blank, case when event_id%11=0 then 0e0 else value/1e1 end as pixel_variance,
  event_id%29=0 as ffc
from {events}""", None),
    "v_tags": (("events",), """
select user_id as track_id, event_id as tag_id,
  case event_type when 'click' then 'rat' when 'view' then 'rodent' when 'purchase' then 'kiwi' when 'signup' then 'bird' else 'false-positive' end as what,
  case event_type when 'click' then 'all.mammal.rodent.rat' when 'view' then 'all.mammal.rodent' when 'purchase' then 'all.bird.kiwi' when 'signup' then 'all.bird' else 'all.other.falsepositive' end as path,
  event_id%3=0 as automatic, 5e-1+(event_id%50)/1e2 as confidence
from {events}""", None),
    "v_clips": (("events",), """
select cast(floor(user_id/3) as bigint) as clip_id, cast(floor(user_id/3) as bigint)%10 as station_id,
  cast(floor(user_id/3) as bigint)%7 as device_id, min(ts) as rec_time,
  1e2+(cast(floor(user_id/3) as bigint)*13)%90 as lng, -5e0-(cast(floor(user_id/3) as bigint)*7)%45 as lat,
  case when cast(floor(user_id/3) as bigint)%17=0 then 'Trapped' else '' end as event, cast(9 as bigint) as fps
from {events} group by cast(floor(user_id/3) as bigint)""", None),
    "v_samples": (("orders", "customer"), """
select o_orderkey as sample_id, o_custkey as clip_id, o_custkey*10+o_orderkey%4 as track_id, cast(c_nationkey as bigint) as station_id,
  o_orderpriority as label, c_mktsegment as original_label, o_orderkey%150 as mass, o_orderdate as rec_time,
  concat('clip-', cast(o_custkey as string)) as source_file
from {orders} join {customer} on o_custkey=c_custkey""", None),
    "v_stream": (("events",), """
select user_id%10 as camera, event_id, ts, cast(floor(value) as bigint) as changed, value>6e1 as motion, event_id%29=0 as ffc from {events}""", None),
    "v_tracks": (("v_regions",), """
select clip_id, track_id, min(frame_number) as start_frame, max(frame_number) as end_frame, count(*) as num_regions from {v_regions} group by clip_id, track_id""", None),
    "v_expected": (("v_tracks",), """
select clip_id, track_id as expected_id, start_frame/9e0+(track_id%5)/1e1 as start_s, (end_frame+1)/9e0-(track_id%3)/1e1 as end_s from {v_tracks}""", None),
    "v_predictions": (("embeddings",), """
select e.vec_id, e.vec_id%50 as track_id, cast(floor(e.vec_id/50) as bigint) as seq, cast(e.label as bigint) as true_idx, 1+e.vec_id%97 as mass, cast(p.pos as bigint) as idx,
 cast(p.v as double)*cast(p.v as double)/sum(cast(p.v as double)*cast(p.v as double)) over (partition by e.vec_id) as score from {embeddings} e lateral view posexplode(slice(embedding,1,10)) p as pos,v""", """
select vec_id, vec_id%50 as track_id, cast(floor(vec_id/50) as bigint) as seq, cast(label as bigint) as true_idx, 1+vec_id%97 as mass, cast(i-1 as bigint) as idx,
 cast(embedding[i] as double)*cast(embedding[i] as double)/sum(cast(embedding[i] as double)*cast(embedding[i] as double)) over (partition by vec_id) as score from {embeddings}, range(1,11) r(i)"""),
    "v_pixels": (("embeddings",), """
select cast(label as bigint) as clip_id, f as frame_number, cast(floor(pos/8) as bigint) as y, cast(pos%8 as bigint) as x, 3e3+1e3*cast(v as double) as v from
 (select label, cast(row_number() over (partition by label order by vec_id)-1 as bigint) as f, embedding from {embeddings}) t lateral view posexplode(embedding) p as pos,v""", """
select cast(label as bigint) as clip_id, f as frame_number, cast(floor((i-1)/8) as bigint) as y, cast((i-1)%8 as bigint) as x, 3e3+1e3*cast(embedding[i] as double) as v from
 (select label, cast(row_number() over (partition by label order by vec_id)-1 as bigint) as f, embedding from {embeddings}) t, range(1,65) r(i)"""),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or a view over driver tables, as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs, text, _ = VIEWS[name]
    return spark.sql(text, **{n: read(spark, sf_dir, n) for n in needs})


def _ordered(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        if n in VIEWS:
            out += [x for x in [*_ordered(VIEWS[n][0]), n] if x not in out]
    return list(dict.fromkeys(out))


def with_views(body: str, *names: str) -> str:
    """SQL of the other engine: ``body`` after the definitions of the views that it reads."""
    parts = [f"{n} as ({(VIEWS[n][2] or VIEWS[n][1]).format(**{x: x for x in VIEWS[n][0]})})" for n in _ordered(names)]
    plain = body.lstrip().lower().startswith("select")
    if plain and not parts:
        return body
    return "with recursive " + ",\n".join(parts) + ("\n" if plain else ",\n" if parts else "") + body
