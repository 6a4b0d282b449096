"""Ordered per-track computations over ``regions`` rows (clip_id, track_id, frame_number, box, mass, ...).

One shuffle by track serves all windows below; nothing here runs Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions import geometry as g


def ordered() -> Window:
    return Window.partitionBy("track_id").orderBy("frame_number")


def so_far() -> Window:
    return ordered().rowsBetween(Window.unboundedPreceding, 0)


def by_track() -> Window:
    return Window.partitionBy("track_id")


def mid(prefix: str = "") -> tuple[Column, Column]:
    b = g.box(prefix)
    return b.mid_x, b.mid_y


def with_velocity(regions: DataFrame) -> DataFrame:
    """Adds vx, vy: the middle minus the one before, 0 for the first region."""
    mx, my = mid()
    return regions.withColumn("vx", F.coalesce(mx - F.lag(mx).over(ordered()), F.lit(0.0))).withColumn("vy", F.coalesce(my - F.lag(my).over(ordered()), F.lit(0.0)))


def with_border(regions: DataFrame, bounds: g.Box, edge: int = 0) -> DataFrame:
    return regions.withColumn("along_border", g.along_border(g.box(), bounds, edge))


def recent_means(regions: DataFrame, last: int = 5) -> DataFrame:
    """Adds average_area and average_mass of the last ``last`` non-blank regions so far (0 without any)."""
    seen = regions.withColumn("_rank", F.sum(F.when(~F.col("blank"), 1).otherwise(0)).over(so_far()))
    window = Window.partitionBy("track_id", "_solid").orderBy("frame_number").rowsBetween(-(last - 1), 0)
    means = seen.withColumn("_solid", ~F.col("blank")).select(
        "*", *[F.when(F.col("_solid"), F.avg(c).over(window)).alias(n) for n, c in (("_area", g.box().area), ("_mass", F.col("mass")))]
    )
    return means.select(
        *regions.columns,
        *[F.coalesce(F.last(c, ignorenulls=True).over(so_far()), F.lit(0.0)).alias(n) for n, c in (("average_area", "_area"), ("average_mass", "_mass"))],
    )


def with_visibility(regions: DataFrame, max_blanks: int = 18) -> DataFrame:
    """Adds since_seen, blanks, clear_run and tracking (whether the track is still alive)."""
    blank = F.col("blank")
    n = F.row_number().over(ordered())
    last_seen = F.last(F.when(~blank, n), ignorenulls=True).over(so_far())
    out = regions.withColumn("_n", n).withColumn("since_seen", F.col("_n") - F.coalesce(last_seen, F.lit(0)))
    out = out.withColumn("blanks", F.sum(blank.cast("long")).over(so_far()))
    # a run of clear frames begins after a blank; blanks keep the run of the last clear frame
    starts = F.sum((~blank & F.coalesce(F.lag("blank").over(ordered()), F.lit(False))).cast("long")).over(so_far())
    out = out.withColumn("_run", starts)
    out = out.withColumn("clear_run", F.sum((~blank).cast("long")).over(Window.partitionBy("track_id", "_run").orderBy("frame_number").rowsBetween(Window.unboundedPreceding, 0)))
    alive = F.col("since_seen") < F.least(2 * (F.col("_n") - F.col("since_seen")), F.lit(max_blanks))
    return out.withColumn("tracking", F.when(blank, alive).otherwise(True)).drop("_n", "_run")


def smooth(regions: DataFrame, bounds: g.Box) -> DataFrame:
    """Replaces each box by the mean size of it and its neighbours around its middle, cropped."""
    mx, my = mid()
    mean = lambda c: (F.coalesce(F.lag(c).over(ordered()), F.col(c)) + F.col(c) + F.coalesce(F.lead(c).over(ordered()), F.col(c))) / 3
    sized = regions.withColumn("_w", mean("width")).withColumn("_h", mean("height"))
    raw = g.Box((mx - F.col("_w") / 2).cast("long"), (my - F.col("_h") / 2).cast("long"), F.col("_w").cast("long"), F.col("_h").cast("long"))
    cut = g.crop(raw, bounds)
    return sized.select(*[c for c in regions.columns if c not in ("x", "y", "width", "height")], *g.columns(cut))


def trim(regions: DataFrame, share: float = 0.005, least: float = 2) -> DataFrame:
    """Drops regions of low mass at both ends of a track."""
    limit = F.greatest(F.lit(float(least)), F.percentile("mass", F.lit(0.5)).over(by_track()) * share)
    heavy = regions.withColumn("_f", F.when(F.col("mass") > limit, F.col("frame_number")))
    inside = F.col("frame_number").between(F.min("_f").over(by_track()), F.max("_f").over(by_track()))
    return heavy.withColumn("_in", inside).where("_in").drop("_f", "_in")


def fill_gaps(regions: DataFrame) -> DataFrame:
    """Adds blank regions with the last box for frame numbers that a track skips."""
    nxt = F.lead("frame_number").over(ordered())
    known = regions.withColumn("_next", F.coalesce(nxt - 1, F.col("frame_number")))
    spread = known.withColumn("_f", F.explode(F.sequence(F.col("frame_number"), F.col("_next"))))
    new = F.col("_f") != F.col("frame_number")
    return spread.select(
        "clip_id", "track_id", F.col("_f").alias("frame_number"), "x", "y", "width", "height", F.when(new, 0).otherwise(F.col("mass")).alias("mass"),
        (new | F.col("blank")).alias("blank"), F.when(new, 0.0).otherwise(F.col("pixel_variance")).alias("pixel_variance"),
    )


def movement_statistics(regions: DataFrame, bounds: g.Box, edge: int = 0) -> DataFrame:
    """One row per track: movement, offset, velocity, variance, jitter, blanks, mass statistics and score."""
    rows = with_border(with_velocity(regions), bounds, edge)
    mx, my = mid()
    prev = {c: F.lag(c).over(ordered()) for c in ("x", "y", "width", "height", "blank", "along_border")}
    rows = rows.select("*", F.row_number().over(ordered()).alias("_n"), *[c.alias("p" + n) for n, c in prev.items()], F.first(mx).over(so_far()).alias("_fx"), F.first(my).over(so_far()).alias("_fy"))
    later, solid = F.col("_n") > 1, ~F.col("blank")
    moving = later & solid & ~F.col("pblank") & (g.moved(g.box(), g.box("p")) | F.col("along_border"))
    offset = (mx - F.col("_fx")) ** 2 + (my - F.col("_fy")) ** 2
    compared = later & ~F.col("along_border") & ~F.col("palong_border")
    dh, dw = F.col("height") - F.col("pheight"), F.col("pwidth") - F.col("width")
    by_h = compared & (F.abs(dh) > F.greatest(F.lit(5.0), F.col("pheight") * 0.3))
    by_w = compared & ~by_h & (F.abs(dw) > F.greatest(F.lit(5.0), F.col("pwidth") * 0.3))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = rows.groupBy("clip_id", "track_id").agg(
        F.count(F.lit(1)).alias("frames"),
        F.coalesce(F.sum(F.when(moving, F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2))), F.lit(0.0)).alias("movement"),
        F.sqrt(F.coalesce(F.max(F.when(moving, offset)), F.lit(0.0))).alias("max_offset"),
        count(moving).alias("frames_moved"),
        (F.sum(F.when(solid, F.abs("vx") + F.abs("vy"))) / count(solid)).alias("average_velocity"),
        F.sqrt(F.avg(F.when(solid & (F.col("pixel_variance") != 0), F.col("pixel_variance")))).alias("delta_std"),
        count((by_h & (dh > 0)) | (by_w & (dw > 0))).alias("jitter_bigger"),
        count((by_h & (dh <= 0)) | (by_w & (dw <= 0))).alias("jitter_smaller"),
        count(F.col("blank")).alias("blank_frames"),
        F.avg(F.when(solid, F.col("mass"))).alias("average_mass"),
        F.percentile(F.when(solid, F.col("mass")), F.lit(0.5)).alias("median_mass"),
        F.stddev_pop(F.when(solid, F.col("mass"))).alias("mass_std"),
    )
    share = lambda c: F.bround(100.0 * c / F.col("frames"), 0).cast("long")
    out = out.withColumn("region_jitter", share(F.col("jitter_bigger") + F.col("jitter_smaller"))).withColumn("blank_percent", share(F.col("blank_frames")))
    points = F.least(F.sqrt("movement") + F.col("max_offset"), F.lit(100.0)) + F.least(F.col("delta_std") * 25, F.lit(100.0))
    return out.withColumn("score", points + (100 - F.col("region_jitter")) + (100 - F.col("blank_percent")))


def quality_reason(frames: Column, min_frames: int = 27, min_offset: float = 4.0, min_moving: int = 2, max_blank: int = 30, max_jitter: int = 20, min_delta: float = 1.0, max_delta: float = 150.0, min_mass: float = 2.0) -> Column:
    """Why a track is filtered out, null if it is not; the first reason counts."""
    c = F.col
    return (
        F.when(frames < min_frames, "too short")
        .when((c("max_offset") < min_offset) | (c("frames_moved") < min_moving), "didn't move")
        .when(c("blank_percent") > max_blank, "too many blanks")
        .when(c("region_jitter") > max_jitter, "too jittery")
        .when(c("delta_std") < min_delta, "too static")
        .when(c("delta_std") > max_delta, "too dynamic")
        .when(c("average_mass") < min_mass, "mass too small")
    )


def size_limit(edge: Column, n: Column, speed: Column) -> Column:
    """How far the size may change: more at the border, for young tracks and for fast ones."""
    return F.when(edge, F.lit(2.0) * F.when(speed > 10, 3).otherwise(1)).otherwise(F.when(n < 5, 2.0).otherwise(1.5) * F.when(speed > 10, 2).otherwise(1))


def match_gates(regions: DataFrame, base_velocity: float = 2, multiplier: float = 2, base_distance: float = 450, mass_percent: float = 0.55, min_mass_change: float = 20, restrict_after: float = 1.5, fps: int = 9) -> DataFrame:
    """Adds max_distance, max_mass_change and max_size_change, how far the next region may differ, and n_regions so far.

    Regions carry vx, vy, average_mass, along_border; no motion is predicted here."""
    n = F.row_number().over(ordered())
    vx = F.when(n == 1, F.lit(float(base_velocity))).otherwise(F.col("vx")) * multiplier
    vy = F.when(n == 1, F.lit(float(base_velocity))).otherwise(F.col("vy")) * multiplier
    speed = F.abs("vx") + F.abs("vy")
    mass = F.when(n > restrict_after * fps, F.greatest(F.lit(float(min_mass_change)), F.col("average_mass") * (mass_percent + F.when(speed > 5, 0.1).otherwise(0.0))))
    nxt = F.lead("along_border").over(ordered())
    size = size_limit(F.col("along_border") | nxt, n, speed)
    return regions.select("*", (base_distance + vx * vx + vy * vy).alias("max_distance"), mass.alias("max_mass_change"), size.alias("max_size_change"), n.alias("n_regions"))


def match_candidates(regions: DataFrame) -> DataFrame:
    """clip_id, track_id, region_track, frame_number, score: the regions of a frame that a track may go on with.

    ``regions`` come from ``match_gates``.  A track stands where it was a frame before; against its gates go the mean
    distance of the corners, the change against its average area and, once it is old enough, against its average mass.
    Blank regions are no candidates; the border counts on either side.  The join is by clip and frame."""
    kept = ("max_distance", "max_mass_change", "average_area", "average_mass", "n_regions")
    track = regions.select(
        "clip_id", "track_id", (F.col("frame_number") + 1).alias("frame_number"), *kept, (F.abs("vx") + F.abs("vy")).alias("speed"), F.col("along_border").alias("a_border"), *g.columns(g.box(), "a_")
    )
    region = regions.where("not blank").select("clip_id", F.col("track_id").alias("region_track"), "frame_number", "mass", F.col("along_border").alias("b_border"), *g.columns(g.box(), "b_"))
    near, _, far = g.corner_distances(g.box("a_"), g.box("b_"))
    pairs = track.join(region, ["clip_id", "frame_number"]).withColumn("score", (near + far) / 2)
    within = lambda value, most: F.round(value, 6) <= F.round(most, 6)
    limit = size_limit(F.col("a_border") | F.col("b_border"), F.col("n_regions"), F.col("speed"))
    fits = within(F.col("score"), F.col("max_distance")) & within(g.size_change(g.box("b_").area, F.col("average_area")), limit)
    heavy = F.coalesce(within(F.abs(F.col("average_mass") - F.col("mass")), F.col("max_mass_change")), F.lit(True))
    return pairs.where(fits & heavy).select("clip_id", "track_id", "region_track", "frame_number", "score")
