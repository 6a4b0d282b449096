"""Track predictions from many model outputs, in long form: one row per (track, prediction, label index)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_track() -> Window:
    return Window.partitionBy("track_id")


def track_scores(predictions: DataFrame, smooth: bool = True) -> DataFrame:
    """track_id, idx, score of whole tracks: scores weighted by mass over all mass, or their plain share."""
    if smooth:
        mass = predictions.select("track_id", "vec_id", "mass").distinct().groupBy("track_id").agg(F.sum("mass").alias("m"))
        sums = predictions.groupBy("track_id", "idx").agg(F.sum(F.col("score") * F.col("mass")).alias("s"))
        return sums.join(mass, "track_id").select("track_id", "idx", (F.col("s") / F.col("m")).alias("score"))
    return normalised(predictions.groupBy("track_id", "idx").agg(F.sum("score").alias("score")))


def running_scores(predictions: DataFrame, smooth: bool = True) -> DataFrame:
    """The incremental form: sums of score, or of its square times mass."""
    term = F.col("score") * F.col("score") * F.col("mass") if smooth else F.col("score")
    return predictions.groupBy("track_id", "idx").agg(F.sum(term).alias("score"))


def normalised(scores: DataFrame) -> DataFrame:
    return scores.withColumn("score", F.col("score") / F.sum("score").over(by_track()))


def ranked(scores: DataFrame) -> DataFrame:
    """Adds place: 1 for the best label of a track; the first index wins a tie."""
    return scores.withColumn("place", F.row_number().over(by_track().orderBy(F.desc(F.round("score", 9)), "idx")))


def best(scores: DataFrame, n: int = 3) -> DataFrame:
    """One row per track: label_k and score_k of the n best, and the clarity."""
    pick = lambda c, k: F.max(F.when(F.col("place") == k, F.col(c)))
    top = ranked(scores).where(F.col("place") <= n).groupBy("track_id")
    out = top.agg(*[pick("idx", k).alias(f"label_{k}") for k in range(1, n + 1)], *[pick("score", k).alias(f"score_{k}") for k in range(1, n + 1)])
    return out.withColumn("clarity", F.col("score_1") - F.col("score_2"))


def capped(scores: DataFrame, few: DataFrame, most: float = 0.5) -> DataFrame:
    """Scale the scores of the tracks in ``few`` (track_id) so that they sum to ``most`` at most."""
    marked = scores.join(few.select("track_id").distinct().withColumn("_few", F.lit(True)), "track_id", "left")
    total = F.sum("score").over(by_track())
    scale = F.when(F.col("_few") & (total > most), most / total).otherwise(1.0)
    return marked.withColumn("score", F.col("score") * scale).drop("_few")


def description(names: Column, label: Column, score: Column, clarity: Column, second: Column, second_score: Column) -> Column:
    """Text of a prediction; ``names`` is an array of label names."""
    name = lambda i: F.element_at(names, (i + 1).cast("int"))
    first = F.format_string("%s %.1f (clarity %.1f)", name(label), score * 10, clarity * 10)
    more = F.when(second_score > 0.5, F.format_string(" [second guess - %s %.1f]", name(second), second_score * 10)).otherwise("")
    return F.concat(F.when(score > 0.5, first).otherwise(F.concat(F.lit("[nothing] "), first)), more)
