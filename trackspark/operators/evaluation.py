"""Evaluation of predicted labels: confusion counts, thresholds, curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How much a right label counts in the score of a model.
LABEL_WEIGHTS = {"bird": 1.2, "vehicle": 0.8, "wallaby": 0.8, "mustelid": 0.9, "human": 0.9, "None": 0.0, "unidentified": 0.0}


def confusion(results: DataFrame, labels: list, true: str = "truth", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """Counts of (true, predicted) over the fixed labels, zeros filled in, in long form.

    A label list is small: it is crossed with itself."""
    spark = results.sparkSession
    by = by or []
    kind = results.schema[true].dataType
    names = spark.createDataFrame([(x,) for x in labels], "v string").select(F.col("v").cast(kind).alias("v"))
    grid = names.select(F.col("v").alias(true)).crossJoin(names.select(F.col("v").alias(pred)))
    for b in by:
        grid = results.select(b).distinct().crossJoin(F.broadcast(grid))  # the grid is bounded by the labels
    n = results.groupBy(*by, true, pred).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, [*by, true, pred], "left").fillna(0, ["n"])


def row_share(cells: DataFrame, true: str = "truth") -> Column:
    """A cell's share of its row, in hundredths; 0 in empty rows."""
    total = F.sum("n").over(Window.partitionBy(true))
    return F.when(total == 0, 0.0).otherwise(F.bround(F.col("n") / total, 2))


def model_score(cells: DataFrame, names: Column, fp: str = "false-positive") -> DataFrame:
    """One row: the weighted accuracy over the labels.  cells: truth, pred (names), n."""
    rows = cells.withColumn("share", row_share(cells))
    per = rows.groupBy("truth").agg(
        F.sum(F.when(F.col("truth") == F.col("pred"), F.col("share")).otherwise(0.0)).alias("acc"),
        F.sum(F.when(F.col("pred").isin(fp, "None", "unidentified"), F.col("share")).otherwise(0.0)).alias("unsure"),
        F.sum("share").alias("all"),
    )
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LABEL_WEIGHTS.items() for x in kv]), F.col("truth")), F.lit(1.0))
    other = F.when(F.col("truth") == "bird", F.when(F.col("all") == 0, 0.0).otherwise(1 - F.col("unsure") - F.col("acc"))).otherwise(0.0)
    return per.agg(F.round(F.sum(F.col("acc") * weight - other), 6).alias("score"))


def curve(scored: DataFrame) -> DataFrame:
    """label, threshold, precision, recall, f1 at every distinct score.  scored: label, score, hit (0/1)."""
    at = scored.groupBy("label", "score").agg(F.sum("hit").alias("h"), F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("label").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    cum = at.select("label", "score", F.sum("h").over(down).alias("tp"), F.sum("n").over(down).alias("k"), F.sum("h").over(Window.partitionBy("label")).alias("all"))
    p, r = F.col("tp") / F.col("k"), F.when(F.col("all") > 0, F.col("tp") / F.col("all")).otherwise(0.0)
    out = cum.select("label", F.col("score").alias("threshold"), p.alias("precision"), r.alias("recall"))
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))
