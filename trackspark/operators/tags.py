"""Tags of tracks: taxonomy, best tag, clip and track filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Birds that keep their own label when labels are grouped.
LAND_BIRDS = ("pukeko", "california quail", "brown quail", "black swan", "quail", "pheasant", "penguin", "duck", "chicken", "rooster")


def regrouped(label: Column, path: Column) -> Column:
    """The group of a label from its dotted path in the taxonomy."""
    parts = F.split(path, r"\.")
    depth, at = F.size(parts), lambda i: F.element_at(parts, i)
    mammal = F.when(depth == 4, at(-2)).otherwise(label)
    other = (
        F.when((at(-2) == "kiwi") | (at(-1) == "kiwi"), F.lit("kiwi"))
        .when(at(-2) == "other", label)
        .when(path.contains("bird."), F.lit("bird"))
        .when(depth > 2, F.try_element_at(parts, F.lit(-3)))
        .otherwise(at(-1))
    )
    return F.when(label.isin(*LAND_BIRDS), label).when(depth == 1, label).when(path.startswith("all.mammal"), mammal).otherwise(other)


def conflicting(what_a: Column, path_a: Column, what_b: Column, path_b: Column) -> Column:
    """Different names on different branches."""
    return (what_a != what_b) & ~(path_a.contains(path_b) | path_b.contains(path_a))


def best_human_tag(tags: DataFrame, precedence: DataFrame | None = None, default: float = 100.0, min_confidence: float = -1.0) -> DataFrame:
    """track_id, what, path of the best human tag, or none where the best ones conflict.

    The lowest of precedence plus one minus confidence wins; among equals on one branch the deepest path,
    and if any two of the equals conflict there is none.  precedence: what, rank."""
    human = tags.where(~F.coalesce(F.col("automatic"), F.lit(False)) & (F.col("confidence") >= min_confidence))
    if precedence is not None:
        human = human.join(F.broadcast(precedence), "what", "left")  # one row per label of the taxonomy
    else:
        human = human.withColumn("rank", F.lit(None).cast("double"))
    ranked = human.withColumn("ranking", F.round(F.coalesce("rank", F.lit(default)) + (1 - F.col("confidence")), 9))
    top = ranked.withColumn("_best", F.min("ranking").over(Window.partitionBy("track_id"))).where(F.col("ranking") == F.col("_best"))
    deepest = top.groupBy("track_id").agg(F.max_by(F.struct("what", "path"), F.struct(F.length("path"), -F.col("tag_id"))).alias("t"), F.collect_set(F.struct("what", "path")).alias("all"))
    clash = F.exists("all", lambda o: conflicting(F.col("t.what"), F.col("t.path"), o["what"], o["path"]))
    return deepest.select("track_id", F.when(~clash, F.col("t.what")).alias("what"), F.when(~clash, F.col("t.path")).alias("path"))


def clip_reason(bounds: tuple[float, float, float, float], after) -> Column:
    """Why a clip is left out: trap, location, date; null if it stays.  bounds: west, south, east, north."""
    west, south, east, north = bounds
    outside = ~(F.col("lng").between(west, east) & F.col("lat").between(south, north))
    return F.when(F.lower("event").contains("trap"), "trap").when(outside, "location").when(F.col("rec_time") <= after, "date")


def track_reason(excluded: list[str], least: float = 0.6) -> Column:
    """Why a track is left out.  Columns: label, human_tags, n_regions, confidence."""
    bad = F.array(*map(F.lit, excluded))
    return (
        F.when(F.col("label").isNull(), "notags")
        .when(F.col("label").isin(excluded) | F.arrays_overlap("human_tags", bad), "tags")
        .when(F.coalesce("n_regions", F.lit(0)) == 0, "no_data")
        .when(F.col("confidence") <= least, "confidence")
    )


def duration_seconds(text: Column) -> Column:
    """Seconds of texts like 30s, 30m, 1.5h; bare numbers are minutes, other units seconds; else null."""
    t = F.trim(text)
    unit = F.regexp_extract(t, r"([A-Za-z])$", 1)
    number = F.regexp_replace(t, "[A-Za-z]$", "").try_cast("double")
    factor = F.when(unit == "", 60.0).when(unit == "m", 60.0).when(unit == "h", 3600.0).otherwise(1.0)
    return number * factor


def inside_window(now: Column, start: Column, end: Column) -> Column:
    """Seconds of the day inside a recording window, which may pass midnight; equal ends mean always."""
    return F.when(start == end, True).when(start < end, (now >= start) & (now < end)).otherwise((now >= start) | (now < end))


def sun_times(day: Column, lat: Column, lng: Column) -> tuple[Column, Column]:
    """Sunrise and sunset in hours UTC of a day of the year, by the usual approximation (within minutes)."""
    rad = F.lit(3.141592653589793 / 180)
    declination = -23.44 * F.cos(rad * (360.0 / 365.0) * (day + 10))
    angle = -F.tan(lat * rad) * F.tan(declination * rad)
    half_day = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), angle))) / rad / 15.0
    b = rad * (360.0 / 365.0) * (day - 81)
    noon = 12.0 - lng / 15.0 - (9.87 * F.sin(2 * b) - 7.53 * F.cos(b) - 1.5 * F.sin(b)) / 60.0
    return noon - half_day, noon + half_day
