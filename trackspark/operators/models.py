"""Plug-in scorers and Spark's own models."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import predictions as p

#: Numbers of a model that may be fetched and sent to the workers.
MOST_CELLS = 10_000_000


class Scorer(Protocol):
    """What a model must offer: its labels, the length of an input, and scores for a batch of inputs."""

    labels: list[str]
    shape: int

    def predict(self, batch: np.ndarray) -> np.ndarray: ...


class CentroidScorer:
    """Scores by closeness to each label's mean vector: the smallest scorer that meets the contract."""

    def __init__(self, labels: list[str], means: np.ndarray) -> None:
        self.labels, self.means, self.shape = labels, means, means.shape[1]

    def predict(self, batch: np.ndarray) -> np.ndarray:
        near = -((batch[:, None, :] - self.means[None]) ** 2).sum(2)
        e = np.exp(near - near.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit_centroids(vectors: DataFrame) -> CentroidScorer:
    """One mean per label, counted in Spark; labels and dimensions are few, which is checked before they are fetched."""
    mean = vectors.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"))
    mean = mean.persist()
    if (cells := mean.count()) > MOST_CELLS:
        raise ValueError(f"{cells} means of labels and dimensions; at most {MOST_CELLS} go to the driver")
    rows = mean.orderBy("label", "i").toPandas()
    mean.unpersist()
    labels = sorted(rows["label"].unique())
    return CentroidScorer(list(map(str, labels)), np.stack([rows[rows["label"] == x]["m"].to_numpy() for x in labels]))


def scored(vectors: DataFrame, scorer: Scorer, keys: list[str]) -> DataFrame:
    """The keys and scores array<double>; the model goes to each Python worker once."""
    shipped = vectors.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[keys].copy()
            x = np.stack(batch["embedding"].to_numpy()) if len(batch) else np.zeros((0, shipped.value.shape))
            out["scores"] = list(shipped.value.predict(x))
            yield out

    source = vectors.select(*keys, "embedding")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.select(*keys).schema)
    return source.mapInPandas(run, f"{types}, scores array<double>")


# --- models in folders ----------------------------------------------------------------------------


@dataclass
class Model:
    """What a model folder holds: labels, the score from which a label is told, how tracks are sampled, and arrays of numbers.

    ``kind`` picks the scorer: ``centroid`` (array ``means``), or ``linear`` (arrays ``weights`` and ``bias``, softmax)."""

    labels: list[str]
    kind: str
    arrays: dict[str, np.ndarray]
    thresholds: dict[str, float] = field(default_factory=dict)
    params: dict[str, float] = field(default_factory=dict)
    version: int = 0

    #: Sampling and combination, where a folder says nothing else.
    DEFAULTS = {"square_width": 2, "from_last": 0, "most_segments": 0, "smooth": 1, "seed": 0, "short_cap": 0.5}

    def param(self, name: str) -> float:
        return self.params.get(name, self.DEFAULTS[name])

    @property
    def frames(self) -> int:
        """Frames of a sample: they fill a square."""
        return int(self.param("square_width")) ** 2

    @property
    def shape(self) -> int:
        return self.arrays["means" if self.kind == "centroid" else "weights"].shape[1]

    def predict(self, batch: np.ndarray) -> np.ndarray:
        if self.kind == "centroid":
            return CentroidScorer(self.labels, self.arrays["means"]).predict(batch)
        z = batch @ self.arrays["weights"].T + self.arrays["bias"]
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def save_model(spark: SparkSession, path: str, model: Model) -> int:
    """Write the next version of a model folder; gives its number.  Versions that are there stay as they are."""
    version = 1 + max(model_versions(spark, path), default=0)
    meta = {"labels": model.labels, "kind": model.kind, "thresholds": model.thresholds, "params": model.params, "version": version}
    rows = [(name, list(map(int, a.shape)), [float(x) for x in a.ravel()]) for name, a in sorted(model.arrays.items())]
    spark.createDataFrame(rows, "name string, shape array<int>, numbers array<double>").coalesce(1).write.parquet(f"{path}/v{version}/arrays")
    # the description comes last: without it there is no version
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/v{version}/model")
    return version


def model_versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that are complete."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
    done = lambda n: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/model/_SUCCESS"))
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and done(n))


def load_model(spark: SparkSession, path: str, version: int | None = None) -> Model:
    """A version of a model folder, the latest by default.  Its size is checked before its numbers are fetched."""
    there = model_versions(spark, path)
    if not there or version not in (None, *there):
        raise FileNotFoundError(f"no version {version or ''} of a model in {path}")
    at = f"{path}/v{version or there[-1]}"
    arrays = spark.read.parquet(f"{at}/arrays")
    if (cells := arrays.agg(F.coalesce(F.sum(F.size("numbers")), F.lit(0))).first()[0]) > MOST_CELLS:
        raise ValueError(f"{cells} numbers in a model; at most {MOST_CELLS} go to the workers")
    meta = json.loads(spark.read.text(f"{at}/model", wholetext=True).first()[0])
    return Model(meta["labels"], meta["kind"], {r.name: np.array(r.numbers).reshape(r.shape) for r in arrays.collect()}, meta["thresholds"], meta["params"], meta["version"])


# --- tracks, end to end ---------------------------------------------------------------------------


def patches(pixels: DataFrame) -> DataFrame:
    """track_id, frame_number, patch array<double>, mass: what of each frame (track_id, frame_number, y, x, v, inside) is in its box.

    The frame's median is taken off; where the patches of a whole track are warmer than that in the median, what is below 0 becomes 0; values are scaled to
    0..1 by the track's limits (a flat track becomes 0).  mass: cells above the median."""
    frame, track = Window.partitionBy("track_id", "frame_number"), Window.partitionBy("track_id")
    level = pixels.groupBy("track_id", "frame_number").agg(F.percentile("v", F.lit(0.5)).alias("_median"))
    inner = pixels.where("inside").join(level, ["track_id", "frame_number"]).withColumn("d", F.col("v") - F.col("_median"))
    inner = inner.withColumn("_mid", F.percentile("d", F.lit(0.5)).over(frame))
    inner = inner.withColumn("c", F.when(F.min("_mid").over(track) > 0, F.greatest("d", F.lit(0.0))).otherwise(F.col("d")))
    low, high = F.min("c").over(track), F.max("c").over(track)
    scaled = inner.withColumn("v", F.when(high > low, (F.col("c") - low) / (high - low)).otherwise(0.0))
    return scaled.groupBy("track_id", "frame_number").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v")))["v"].alias("patch"), F.count(F.when(F.col("d") > 0, 1)).alias("mass"))


def samples(found: DataFrame, model: Model) -> DataFrame:
    """track_id, segment, frames, embedding, mass: samples of a track's patches, each of as many frames as the model takes.

    The last ``from_last`` frames (0: all), in an order by hash, are cut into samples; one that is short repeats its frames in turn."""
    rows = found
    if last := int(model.param("from_last")):
        rows = rows.withColumn("_back", F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("frame_number")))).where(F.col("_back") <= last)
    drawn = F.md5(F.concat_ws("|", F.lit(int(model.param("seed"))), "track_id", "frame_number").cast("binary"))
    rows = rows.withColumn("segment", ((F.row_number().over(Window.partitionBy("track_id").orderBy(drawn, "frame_number")) - 1) / model.frames).cast("long"))
    if most := int(model.param("most_segments")):
        rows = rows.where(F.col("segment") < most)
    one = rows.groupBy("track_id", "segment").agg(F.array_sort(F.collect_list(F.struct("frame_number", "patch"))).alias("_f"), F.sum("mass").alias("mass"))
    filled = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(model.frames - 1)), lambda i: F.get(F.col("_f"), i % F.size("_f"))["patch"]))
    return one.select("track_id", "segment", F.col("_f.frame_number").alias("frames"), filled.alias("embedding"), "mass")


def classify_tracks(found: DataFrame, model: Model) -> DataFrame:
    """track_id, label, score, clarity, tag, samples, version: patches of tracks scored and combined.

    Scores of samples count by mass (plainly without ``smooth``, or where all masses are 0).  A track of one sample with fewer frames than a quarter of it says little: unless it is a
    false-positive, its scores are scaled down to ``short_cap`` in all.  tag: the label, if its score reaches the label's threshold."""
    taken = samples(found, model)
    out = scored(taken.select("track_id", "segment", "mass", F.size("frames").alias("n_frames"), "embedding"), model, ["track_id", "segment", "mass", "n_frames"])
    long = out.select("track_id", F.col("segment").alias("vec_id"), "mass", "n_frames", F.posexplode("scores").alias("idx", "score"))
    total = F.sum("mass").over(Window.partitionBy("track_id", "idx"))
    weight = F.when((total > 0) & F.lit(bool(model.param("smooth"))), F.col("mass") / total).otherwise(1.0 / F.count(F.lit(1)).over(Window.partitionBy("track_id", "idx")))
    sums = long.withColumn("_w", weight).groupBy("track_id", "idx").agg(F.sum(F.col("score") * F.col("_w")).alias("score"), F.count(F.lit(1)).alias("samples"), F.max("n_frames").alias("n_frames"))
    top = p.ranked(sums).where("place = 1").select("track_id", F.col("idx").alias("_top"))
    few = sums.join(top, "track_id").where((F.col("samples") == 1) & (F.col("n_frames") < model.frames / 4))
    if "false-positive" in model.labels:
        few = few.where(F.col("_top") != model.labels.index("false-positive"))
    best = p.best(p.capped(sums.select("track_id", "idx", "score"), few, model.param("short_cap")))
    name = F.element_at(F.array(*map(F.lit, model.labels)), F.col("label_1").cast("int") + 1)
    least = F.element_at(F.array(*(F.lit(float(model.thresholds.get(x, 0.0))) for x in model.labels)), F.col("label_1").cast("int") + 1)
    n = taken.groupBy("track_id").agg(F.count(F.lit(1)).alias("samples"))
    return best.join(n, "track_id").select("track_id", name.alias("label"), F.col("score_1").alias("score"), "clarity", F.when(F.col("score_1") >= least, name).alias("tag"), "samples", F.lit(model.version).alias("version"))


def forest(features: DataFrame, trees: int = 10, depth: int = 5):
    """A random forest on features array and label."""
    ready = features.withColumn("v", array_to_vector(F.col("features").cast("array<double>")))
    return RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=trees, maxDepth=depth, seed=3).fit(ready)


def forest_scores(model, features: DataFrame, *keys: str) -> DataFrame:
    ready = features.withColumn("v", array_to_vector(F.col("features").cast("array<double>")))
    return model.transform(ready).select(*keys, F.col("prediction").cast("int").alias("pred"), F.array_max(vector_to_array("probability")).alias("confidence"))


def grid_search(features: DataFrame, trees: list[int], depths: list[int]) -> DataFrame:
    """trees, depth, accuracy of every combination, on a quarter that is held out."""
    ready = features.withColumn("v", array_to_vector(F.col("features").cast("array<double>")))
    rf = RandomForestClassifier(featuresCol="v", labelCol="label", seed=3)
    grid = ParamGridBuilder().addGrid(rf.numTrees, trees).addGrid(rf.maxDepth, depths).build()
    found = TrainValidationSplit(estimator=rf, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), trainRatio=0.75, seed=3).fit(ready)
    rows = [(int(g[rf.numTrees]), int(g[rf.maxDepth]), float(m)) for g, m in zip(grid, found.validationMetrics, strict=True)]
    return features.sparkSession.createDataFrame(rows, "trees int, depth int, accuracy double")


#: Settings of the reference job; an axis changes one of them at a time.
REFERENCE = {"trees": 10, "depth": 5}
JOBS = "trees int, depth int, accuracy double, job string"


def held_out(features: DataFrame) -> Column:
    """A quarter of the rows, by their values: the same one in every job and after a restart."""
    return F.pmod(F.xxhash64("features", "label"), F.lit(4)) == 0


def axis_search(features: DataFrame, axes: dict[str, list[int]], path: str, reference: dict[str, int] | None = None) -> DataFrame:
    """job, trees, depth, accuracy: the reference job, then each value of each axis with all else as in the reference.

    ``path`` is the job log, one folder for one search (data and reference).  A finished job is a partition of it, so a
    search that was interrupted goes on behind the last finished job, and none is ever there twice.  Accuracy is null
    where no row is held out; without rows to learn from no job runs."""
    spark, base = features.sparkSession, REFERENCE | (reference or {})
    jobs = {"reference": base} | {f"{axis}={value}": base | {axis: value} for axis, values in axes.items() for value in values}
    spark.createDataFrame([], JOBS).write.mode("append").partitionBy("job").parquet(path)
    log = lambda: spark.read.schema(JOBS).parquet(path)
    done = {r.job for r in log().where(F.col("job").isin(*jobs)).select("job").collect()}
    learnt, tested = features.where(~held_out(features)), features.where(held_out(features))
    if learnt.isEmpty():
        return log()
    for job, setting in jobs.items():
        if job in done:
            continue
        scores = forest_scores(forest(learnt, setting["trees"], setting["depth"]), tested, "label")
        accuracy = scores.agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"))
        row = accuracy.select(F.lit(setting["trees"]).alias("trees"), F.lit(setting["depth"]).alias("depth"), "accuracy", F.lit(job).alias("job"))
        row.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job").parquet(path)
    return log()
