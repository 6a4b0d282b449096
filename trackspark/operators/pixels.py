"""Per-pixel work over exploded frames (clip_id, frame_number, y, x, v).

Windows partition by clip and pixel, so frames of one clip are never gathered in one place but for
the two backgrounds that depend on their own past, which fold one pixel's values in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pixel() -> Window:
    return Window.partitionBy("clip_id", "y", "x").orderBy("frame_number")


def frame() -> Window:
    return Window.partitionBy("clip_id", "frame_number")


def frame_statistics(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("clip_id", "frame_number").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.percentile("v", F.lit(0.5)).alias("median"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def running_mean(pixels: DataFrame, n: int = 45) -> DataFrame:
    return pixels.withColumn("mean", F.avg("v").over(pixel().rowsBetween(-(n - 1), 0)))


def change_counts(pixels: DataFrame, gap: int, low: float, delta: float, warmer_only: bool = True) -> DataFrame:
    """clip_id, frame_number, changed: pixels that differ by over ``delta`` from ``gap`` frames ago, both clipped at ``low``."""
    v = F.greatest(F.col("v"), F.lit(low))
    diff = v - F.lag(v, gap).over(pixel())
    hit = diff > delta if warmer_only else F.abs(diff) > delta
    return pixels.withColumn("_hit", F.coalesce(hit, F.lit(False)).cast("long")).groupBy("clip_id", "frame_number").agg(F.sum("_hit").alias("changed"))


def trigger_runs(frames: DataFrame, hit: Column, reset: Column, by: str, *order: str) -> DataFrame:
    """Adds run: how many triggers came in a row, 0 on a quiet frame or a reset."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = frames.withColumn("_hit", (hit & ~reset).cast("long")).withColumn("_island", F.sum((~hit | reset).cast("long")).over(w))
    return counted.withColumn("run", F.sum("_hit").over(Window.partitionBy(by, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).drop("_hit", "_island")


def normalised(v: Column, new_max: float = 1.0, by: Window | None = None) -> Column:
    """Scaled to 0..new_max within a frame; flat frames become zeros, or v over the maximum."""
    by = by or frame()
    low, high = F.min(v).over(by), F.max(v).over(by)
    return F.when(high == low, F.when(high == 0, 0.0).otherwise(v / high)).otherwise((v - low) / (high - low) * new_max)


def weighted_background(pixels: DataFrame, step: float = 1.0) -> DataFrame:
    """clip_id, y, x, background after the last frame.

    A pixel falls to a colder value at once; it rises only by as much as its weight has grown: the weight
    gains ``step`` on each warmer frame and is 0 again whenever the background changes."""
    frames = F.array_sort(F.collect_list(F.struct("frame_number", "v")))
    start = F.struct(F.element_at(F.col("f"), 1)["v"].alias("bg"), F.lit(0.0).alias("w"))

    def fold(acc: Column, x: Column) -> Column:
        takes = acc["bg"] >= x["v"] - acc["w"]
        return F.struct(F.when(takes, x["v"]).otherwise(acc["bg"]).alias("bg"), F.when(takes, 0.0).otherwise(acc["w"] + step).alias("w"))

    return pixels.groupBy("clip_id", "y", "x").agg(frames.alias("f")).select("clip_id", "y", "x", F.aggregate("f", start, fold, lambda a: a["bg"]).alias("background"))


def masked_mean_background(pixels: DataFrame, threshold: float = 50.0) -> DataFrame:
    """clip_id, y, x, background: the mean of the values that were not foreground when they came."""
    frames = F.array_sort(F.collect_list(F.struct("frame_number", "v")))
    start = F.struct(F.element_at(F.col("f"), 1)["v"].alias("sum"), F.lit(1).alias("n"))

    def fold(acc: Column, x: Column) -> Column:
        still = F.abs(x["v"] - acc["sum"] / acc["n"]) <= threshold
        return F.struct(F.when(still, acc["sum"] + x["v"]).otherwise(acc["sum"]).alias("sum"), F.when(still, acc["n"] + 1).otherwise(acc["n"]).alias("n"))

    rest = F.slice("f", 2, F.size("f") - 1)
    return pixels.groupBy("clip_id", "y", "x").agg(frames.alias("f")).select("clip_id", "y", "x", F.aggregate(rest, start, fold, lambda a: a["sum"] / a["n"]).alias("background"))


def moments(pixels: DataFrame) -> DataFrame:
    """Per frame: weighted centre, half axes and angle of the value distribution (values above the frame's minimum)."""
    w = F.col("v") - F.min("v").over(frame())
    m = pixels.withColumn("w", w).groupBy("clip_id", "frame_number").agg(
        F.sum("w").alias("s"), F.sum(F.col("w") * F.col("x")).alias("sx"), F.sum(F.col("w") * F.col("y")).alias("sy"),
        F.sum(F.col("w") * F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("w") * F.col("x") * F.col("y")).alias("sxy"),
    )
    c = m.withColumn("cx", F.col("sx") / F.col("s")).withColumn("cy", F.col("sy") / F.col("s"))
    c = c.withColumn("a", F.col("sxx") / F.col("s") - F.col("cx") ** 2).withColumn("d", F.col("syy") / F.col("s") - F.col("cy") ** 2).withColumn("b", F.col("sxy") / F.col("s") - F.col("cx") * F.col("cy"))
    root = F.sqrt(((F.col("a") - F.col("d")) / 2) ** 2 + F.col("b") ** 2)
    mean = (F.col("a") + F.col("d")) / 2
    return c.select("clip_id", "frame_number", "cx", "cy", F.sqrt(mean + root).alias("major"), F.sqrt(F.greatest(F.lit(0.0), mean - root)).alias("minor"), (0.5 * F.atan2(2 * F.col("b"), F.col("a") - F.col("d"))).alias("angle"))
