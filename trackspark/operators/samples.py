"""Training samples from tracks and balanced splits of them.

Random choices order by md5 of a seed and a key, which any engine computes alike and any number of
machines computes without talking to each other.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(seed: str, *keys: str) -> Column:
    """A pseudo-random order by seed and keys."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def ranked(df: DataFrame, by: list[str], seed: str, *keys: str) -> DataFrame:
    """Adds rn, the place in random order within each group of ``by`` (from 1)."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(shuffled(seed, *keys), *keys)).cast("long"))


def random_segments(frames: DataFrame, width: int, seed: str) -> DataFrame:
    """track_id, segment, frames: usable frames in random order, cut into chunks of ``width``."""
    cut = ranked(frames, ["track_id"], seed, "track_id", "frame_number").withColumn("segment", F.floor((F.col("rn") - 1) / width))
    return cut.groupBy("track_id", "segment").agg(F.array_sort(F.collect_list("frame_number")).alias("frames"))


def section_segments(frames: DataFrame, width: int, stretch: float, seed: str) -> DataFrame:
    """Random ``width`` frames of each section of ``stretch * width`` frames, sections ``width`` apart."""
    numbered = frames.withColumn("i", F.row_number().over(Window.partitionBy("track_id").orderBy("frame_number")) - 1)
    span = int(width * stretch)
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - span + 1) / width)).cast("long")
    spread = numbered.withColumn("segment", F.explode(F.sequence(first, F.floor(F.col("i") / width).cast("long"))))
    chosen = ranked(spread, ["track_id", "segment"], seed, "segment", "track_id", "frame_number").where(F.col("rn") <= width)
    return chosen.groupBy("track_id", "segment").agg(F.array_sort(F.collect_list("frame_number")).alias("frames"))


def sequential_segments(frames: DataFrame, width: int, spacing: int) -> DataFrame:
    """Every window of ``width`` usable frames that starts at a multiple of ``spacing`` of them."""
    numbered = frames.withColumn("i", F.row_number().over(Window.partitionBy("track_id").orderBy("frame_number")) - 1)
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - width + 1) / spacing)).cast("long")
    spread = numbered.withColumn("first", first).where(F.col("first") <= F.floor(F.col("i") / spacing))
    spread = spread.withColumn("segment", F.explode(F.sequence(F.col("first"), F.floor(F.col("i") / spacing).cast("long"))))
    return spread.groupBy("track_id", "segment").agg(F.array_sort(F.collect_list("frame_number")).alias("frames")).where(F.size("frames") == width)


def topped_up(frames: Column, width: int) -> Column:
    """Repeat a segment's own frames in turn until it has ``width``."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.element_at(frames, (i % F.size(frames) + 1).cast("int")))


def accepted(segments: DataFrame, width: int) -> DataFrame:
    """A first segment needs a quarter of the width, later ones half of it."""
    n = F.size("frames")
    return segments.where((n * 4 >= width) & ((F.col("segment") == 0) | (n * 2 >= width)))


def fill_splits(bins: DataFrame, limits: list[tuple[str, int, int]], seed: str, rest: str = "train") -> DataFrame:
    """bin_id, split: bins in random order fill each split until it has its samples and its tracks.

    bins: bin_id, samples, tracks.  A bin goes whole into one split; ``limits``: (split, samples, tracks)
    in the order of filling; what is left goes to ``rest``."""
    label = Window.partitionBy("label")
    before = label.orderBy(shuffled(seed, "bin_id"), "bin_id").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    out = bins.withColumn("_s", F.coalesce(F.sum("samples").over(before), zero)).withColumn("_t", F.coalesce(F.sum("tracks").over(before), zero)).withColumn("split", F.lit(None).cast("string"))
    taken = (zero, zero)  # what the splits before this one have: each takes a stretch of the order, so sums go on from there
    for split, samples, tracks in limits:
        open_ = F.col("split").isNull() & ((F.col("_s") - taken[0] < samples) | (F.col("_t") - taken[1] < tracks))
        out = out.withColumn("split", F.when(open_, split).otherwise(F.col("split")))
        held = [F.coalesce(F.sum(F.when(F.col("split") == split, F.col(c))).over(label), zero) for c in ("samples", "tracks")]
        out = out.withColumn(f"_s_{split}", taken[0] + held[0]).withColumn(f"_t_{split}", taken[1] + held[1])
        taken = (F.col(f"_s_{split}"), F.col(f"_t_{split}"))
    return out.select(*bins.columns, F.coalesce("split", F.lit(rest)).alias("split"))


def clamped_weights(counts: DataFrame, low: float = 0.25, high: float = 4.0) -> DataFrame:
    """label, weight: the mean count over a label's count, within bounds; 0 for absent labels."""
    all_ = Window.partitionBy(F.lit(0))
    used = F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(all_)
    weight = F.least(F.lit(high), F.greatest(F.lit(low), F.sum("n").over(all_) / (F.col("n") * used)))
    return counts.withColumn("weight", F.when(F.col("n") == 0, 0.0).otherwise(weight))
