"""g01-g21: boxes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackspark.functions import geometry as g

from .base import query, r6

KEY = ("clip_id", "track_id", "frame_number")
LEFT_LINE, RIGHT_LINE = g.Line(1.3, 20.0), g.Line(-1.1, 200.0)


def screen() -> g.Box:
    return g.fixed(0, 0, 160, 120)


def inner() -> g.Box:
    return g.fixed(1, 1, 158, 118)


def track() -> Window:
    return Window.partitionBy("track_id").orderBy("frame_number")


LAG = """l as (select *, lag(x) over w as px, lag(y) over w as py, lag(width) over w as pw, lag(height) over w as ph from v_regions window w as (partition by track_id order by frame_number))
"""


def before() -> g.Box:
    return g.Box(*(F.lag(c).over(track()) for c in ("x", "y", "width", "height")))


def lagged(df):
    """Regions with the box before beside them."""
    return df.select("*", *[c.alias("p" + n) for c, n in zip(before(), ("x", "y", "width", "height"), strict=True)]).where("px is not null")


def keyed(df, *cols):
    return df.select(*KEY, *cols)


@query("g01_ltrb_ltwh", "v_regions", sql="select clip_id, track_id, frame_number, x as l, y as t, x+width as r, y+height as b, greatest(0, x-10) as dx, greatest(0, width-12) as dw, greatest(0, height-12) as dh from v_regions")
def g01(v):
    b = g.box()
    d = g.decoded(F.greatest(F.lit(0), b.x - 10), b.y, F.greatest(F.lit(0), b.x - 10) + b.w - 12, b.y + b.h - 12)
    return keyed(v, b.x.alias("l"), b.y.alias("t"), b.right.alias("r"), b.bottom.alias("b"), d.x.alias("dx"), d.w.alias("dw"), d.h.alias("dh"))


@query("g02_mid_area_elongation", "v_regions", sql="select clip_id, track_id, frame_number, x+width/2e0 as mid_x, y+height/2e0 as mid_y, width*height as area, round(greatest(width,height)/cast(least(width,height) as double), 6) as elongation from v_regions")
def g02(v):
    b = g.box()
    return keyed(v, b.mid_x.alias("mid_x"), b.mid_y.alias("mid_y"), b.area.alias("area"), r6(g.elongation(b)).alias("elongation"))


@query("g03_overlap_area", "v_regions", sql=LAG + "select clip_id, track_id, frame_number, greatest(0, least(x+width, px+pw)-greatest(x,px))*greatest(0, least(y+height, py+ph)-greatest(y,py)) as overlap from l where px is not null")
def g03(v):
    return keyed(lagged(v), g.overlap_area(g.box(), g.box("p")).alias("overlap"))


CROP = """select clip_id, track_id, frame_number, l as x, t as y, r-l as width, b-t as height from (select clip_id, track_id, frame_number,
 least({x1}, greatest(x, {x0})) as l, least({y1}, greatest(y, {y0})) as t, greatest({x0}, least(x+width, {x1})) as r, greatest({y0}, least(y+height, {y1})) as b from {src})"""


@query("g04_crop", "v_regions", sql=CROP.format(x0=20, y0=15, x1=120, y1=90, src="v_regions"))
def g04(v):
    return keyed(v, *g.columns(g.crop(g.box(), g.fixed(20, 15, 100, 75))))


@query("g05_enlarge", "v_regions", sql="e as (select clip_id, track_id, frame_number, x-4 as x, y-4 as y, width+8 as width, height+8 as height from v_regions)\n" + CROP.format(x0=0, y0=0, x1=160, y1=120, src="e"))
def g05(v):
    return keyed(v, *g.columns(g.enlarge(g.box(), 4, screen())))


@query("g06_enlarge_even", "v_regions", sql="""e as (select clip_id, track_id, frame_number, x-12 as x, y-9 as y, width+24 as width, height+18 as height from v_regions),
s as (select *, greatest(least(greatest(-x,0),160), least(greatest(x+width-160,0),160)) as sx, greatest(least(greatest(-y,0),120), least(greatest(y+height-120,0),120)) as sy from e)
select clip_id, track_id, frame_number, x+sx as x, y+sy as y, width-2*sx as width, height-2*sy as height from s""")
def g06(v):
    return keyed(v, *g.columns(g.enlarge_even(g.box(), 12, 9, screen())))


@query("g07_enlarge_for_rotation", "v_regions", sql="""m as (select *, 13/least(32e0/width, 32e0/height) as more, abs(width-height) as d from v_regions),
e as (select *, cast(ceil(case when width>height then more/2 else (more+d)/2 end) as bigint) as dx, cast(ceil(case when width>height then (more+d)/2 else more/2 end) as bigint) as dy from m),
f as (select clip_id, track_id, frame_number, x-dx as x, y-dy as y, width+2*dx as width, height+2*dy as height from e),
s as (select *, greatest(least(greatest(-x,0),160), least(greatest(x+width-160,0),160)) as sx, greatest(least(greatest(-y,0),120), least(greatest(y+height-120,0),120)) as sy from f)
select clip_id, track_id, frame_number, x+sx as x, y+sy as y, width-2*sx as width, height-2*sy as height from s""")
def g07(v):
    return keyed(v, *g.columns(g.enlarge_for_rotation(g.box(), screen())))


@query("g08_contains", "v_clips", sql="select clip_id, (lng>=113.0 and lng<=154.0 and lat<=-10.0 and lat>=-44.0) as inside from v_clips")
def g08(v):
    return v.select("clip_id", g.holds_point(g.from_edges(F.lit(113.0), F.lit(-10.0), F.lit(154.0), F.lit(-44.0)), F.col("lng"), F.col("lat")).alias("inside"))


@query("g09_region_array", "v_regions", sql="select clip_id, track_id, frame_number, concat_ws(',', x, y, x+width, y+height, frame_number, mass, case when blank then 1 else 0 end) as wire from v_regions")
def g09(v):
    b = g.box()
    wire = F.array(b.x, b.y, b.right, b.bottom, F.col("frame_number"), F.col("mass"), F.col("blank").cast("long"))
    return keyed(v, F.array_join(wire.cast("array<string>"), ",").alias("wire"))


@query("g10_has_moved", "v_regions", sql=LAG + "select clip_id, track_id, frame_number, (x<>px and x+width<>px+pw) or (y<>py and y+height<>py+ph) as moved from l where px is not null")
def g10(v):
    return keyed(lagged(v), g.moved(g.box(), g.box("p")).alias("moved"))


@query("g11_along_border", "v_regions", sql="select clip_id, track_id, frame_number, x<=2 or y<=2 or x+width>=157 or y+height>=117 as along_border from v_regions")
def g11(v):
    return keyed(v, g.along_border(g.box(), inner(), 1).alias("along_border"))


@query("g12_corner_distances", "v_regions", sql=LAG + """select clip_id, track_id, frame_number, (x-px)*(x-px)+(y-py)*(y-py) as top_left,
 power(trunc(x+width/2e0)-(px+pw/2e0), 2)+power(trunc(y+height/2e0)-(py+ph/2e0), 2) as middle, power(x+width-px-pw, 2)+power(y+height-py-ph, 2) as bottom_right from l where px is not null""")
def g12(v):
    a, m, z = g.corner_distances(g.box("p"), g.box())
    return keyed(lagged(v), a.alias("top_left"), m.alias("middle"), z.cast("double").alias("bottom_right"))


@query("g13_rescale", "v_regions", sql="select clip_id, track_id, frame_number, cast(trunc(x*1.7e0) as bigint) as x, cast(trunc(y*1.7e0) as bigint) as y, cast(trunc(width*1.7e0) as bigint) as width, cast(trunc(height*1.7e0) as bigint) as height, round(mass*(1.7e0*1.7e0), 6) as mass from v_regions")
def g13(v):
    return keyed(v, *g.columns(g.rescaled(g.box(), 1.7)), r6(F.col("mass") * (1.7 * 1.7)).alias("mass"))


@query("g14_edge_flags", "v_regions", sql="select clip_id, track_id, frame_number, y=1 or y+height=119 as on_height_edge, x=1 or x+width=159 as on_width_edge from v_regions")
def g14(v):
    b = g.box()
    return keyed(v, ((b.y == inner().y) | (b.bottom == inner().bottom)).alias("on_height_edge"), ((b.x == inner().x) | (b.right == inner().right)).alias("on_width_edge"))


@query("g15_frame_crop", "v_regions", sql="""s as (select *, greatest(width,height) as d from v_regions)
select clip_id, track_id, frame_number, round(1-greatest(0, least(159e0, x+width/2e0+d/2e0)-greatest(0e0, x+width/2e0-d/2e0))*greatest(0, least(119e0, y+height/2e0+d/2e0)-greatest(0e0, y+height/2e0-d/2e0))/(d*d), 6) as outside from s""")
def g15(v):
    return keyed(v, r6(g.cropped_share(g.box(), 160, 120)).alias("outside"))


@query("g16_rect_distance", "v_regions", sql=LAG + """select clip_id, track_id, frame_number, round(sqrt(cast(dx*dx+dy*dy as double)), 6) as gap from (select *,
 case when width+pw>greatest(x+width,px+pw)-least(x,px) then 0 when x<px then px-x-width else x-px-pw end as dx,
 case when height+ph>greatest(y+height,py+ph)-least(y,py) then 0 when y<py then py-y-height else y-py-ph end as dy from l where px is not null)""")
def g16(v):
    return keyed(lagged(v), r6(g.gap(g.box(), g.box("p"))).alias("gap"))


@query("g17_line_tests", "v_regions", sql="select clip_id, track_id, frame_number, y>x*1.3e0+20 as above, not (y>x*1.3e0+20) as below, x<(y-20)/1.3e0 as to_left, not (x<(y-20)/1.3e0) as to_right from v_regions")
def g17(v):
    x, y = F.col("x"), F.col("y")
    return keyed(v, LEFT_LINE.above(x, y).alias("above"), LEFT_LINE.below(x, y).alias("below"), LEFT_LINE.left(x, y).alias("to_left"), LEFT_LINE.right(x, y).alias("to_right"))


def zone_entry(regions, left: g.Line, right: g.Line, height: int = 120, smallest=(6, 4)):
    """Whether a track is inside a zone whose mouth lies between two lines.

    The side by which a track first comes (left, right or middle of the mouth) decides how far it must be
    inside: half of the box beyond the line of that side, or both lower corners between the lines.
    Boxes smaller than ``smallest`` are never inside."""
    b = g.box()
    y = height - b.bottom
    beyond_left = left.above(b.right, y) & left.left(b.right, y)
    beyond_right = right.above(b.x, y) & right.right(b.x, y)
    side = F.when(beyond_left, 1).when(beyond_right, 2).otherwise(4)
    first = F.first(side).over(Window.partitionBy("track_id").orderBy("frame_number").rowsBetween(Window.unboundedPreceding, 0))
    half_left, half_right = ~left.left(b.mid_x, y), right.left(b.mid_x, y)
    inside = F.when((b.w < smallest[0]) | (b.h < smallest[1]), False).when(first == 1, half_left).when(first == 2, half_right).otherwise(half_left & half_right)
    return regions.withColumn("entry", first).withColumn("in_zone", inside)


@query("g18_zone_entry", "v_regions", sql="""s as (select *, 120-(y+height) as q from v_regions),
f as (select *, first_value(case when q>(x+width)*1.3e0+20 and x+width<(q-20)/1.3e0 then 1 when q>x*-1.1e0+200 and not (x<(q-200)/-1.1e0) then 2 else 4 end) over (partition by track_id order by frame_number) as entry,
 not (x+width/2e0<(q-20)/1.3e0) as hl, x+width/2e0<(q-200)/-1.1e0 as hr from s)
select clip_id, track_id, frame_number, entry, case when width<6 or height<4 then false when entry=1 then hl when entry=2 then hr else hl and hr end as in_zone from f""")
def g18(v):
    return keyed(zone_entry(v, LEFT_LINE, RIGHT_LINE), "entry", "in_zone")


@query("g19_zone_filter", "v_regions", sql="""s as (select *, 120-(y+height) as q from v_regions)
select clip_id, track_id, frame_number from s where not ((q>(x+width)*1.3e0+20 and x+width<(q-20)/1.3e0) or (q>x*-1.1e0+200 and not (x<(q-200)/-1.1e0)))""")
def g19(v):
    b = g.box()
    y = 120 - b.bottom
    beyond = (LEFT_LINE.above(b.right, y) & LEFT_LINE.left(b.right, y)) | (RIGHT_LINE.above(b.x, y) & RIGHT_LINE.right(b.x, y))
    return keyed(v.where(~beyond))


@query("g20_size_change", "v_regions", sql=LAG + "select clip_id, track_id, frame_number, round(abs(width*height-pw*ph)/cast(pw*ph+50 as double), 6) as change from l where px is not null")
def g20(v):
    return keyed(lagged(v), r6(g.size_change(g.box().area, g.box("p").area)).alias("change"))


@query("g21_fit_to_image", "v_regions", sql="""select clip_id, track_id, frame_number, case when greatest(x,10)+width>110 then 110-width else greatest(x,10) end as x,
 case when greatest(y,10)+height>80 then 80-height else greatest(y,10) end as y, width, height from v_regions""")
def g21(v):
    return keyed(v, *g.columns(g.fit_inside(g.box(), g.fixed(10, 10, 100, 70))))
