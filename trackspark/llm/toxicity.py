"""Operator 2: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of two lexicons (a short fixed list of insults, and words learnt
from the labels), how often a lexicon word stands near a second-person pronoun, the share of capitals
and of words in capitals, punctuation and exclamation rates, obfuscation rates (letters masked by
symbols or digits, lexicon words found only after undoing that), and length.

Fitting takes a bounded sample of labelled rows, about ``SAMPLE_ROWS`` chosen by a hash of the id: part
of them learns the lexicon and the trees, the rest the calibration.  Every document is scored, whole.

Cases: null text has the features of an empty one and is scored; labels of rows that are missing or
null are not learnt; several labels of one id count as toxic if any is; with labels of one kind only,
the score is that label's share; repeated rows are scored alike; other columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE_ROWS = 8000
#: Of the sample, tenths that calibrate.
CALIBRATION = 3
LEARNT = 300
#: A learnt word is in this many toxic sample documents at least, and its log odds are at least that.
SUPPORT = 8
LOG_ODDS = 2.5
NEAR = 4
TREES = 20
DEPTH = 4

#: Insults, and second-person words of the languages at hand.
INSULTS = frozenset("idiot idiots moron morons stupid dumb trash scum loser losers clown clowns pathetic worthless disgusting garbage filth vermin imbecile fool".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros".split())

_TOKEN = re.compile(r"[\w@$*!]+")
_MASKED = re.compile(r"[^\W\d_][\d@$*!]+[^\W\d_]")
_PLAIN = str.maketrans("013457@$!", "oieastasi", "*_")
_UPPER, _PUNCT, _BANG = range(1, 4)
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = _UPPER
_CLASS[[*range(0x22, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = _PUNCT
_CLASS[[0x21, 0x3F]] = _BANG

FEATURES = ("insults", "learnt", "insult_words", "learnt_words", "near_second", "second", "capitals", "shouted", "punctuation", "exclamation", "masked", "unmasked", "log_words")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def features(text: str | None, learnt: frozenset[str]) -> list[float]:
    text = text or ""
    words = tokens(text)
    n = max(1, len(words))
    bad = [i for i, w in enumerate(words) if w in INSULTS or w.strip("!*$@") in INSULTS]
    more = [i for i, w in enumerate(words) if w in learnt] if learnt else []
    you = [i for i, w in enumerate(words) if w in SECOND]
    masked = _MASKED.findall(text)
    undone = sum(1 for w in words if not w.isalpha() and w not in INSULTS and w.translate(_PLAIN) in INSULTS) if masked or bad else 0
    near = 0
    if you and (bad or more):
        at = np.asarray(you)
        lex = np.unique(np.asarray(bad + more))
        near = int((np.minimum(np.abs(lex - at[np.searchsorted(at, lex).clip(0, len(at) - 1)]), np.abs(lex - at[(np.searchsorted(at, lex) - 1).clip(0)])) <= NEAR).sum())
    data = common.as_bytes(text)
    kinds = np.bincount(_CLASS[data], minlength=4) if len(data) else np.zeros(4)
    size = max(1, len(data))
    shouted = len(re.findall(r"\b[A-Z]{3,}\b", text)) if kinds[_UPPER] > 2 else 0
    return [
        len(bad) / n, len(more) / n, float(len({words[i] for i in bad})), float(len({words[i] for i in more})), near / n, len(you) / n,
        kinds[_UPPER] / size, shouted / n, kinds[_PUNCT] / size, kinds[_BANG] / size, len(masked) / n, undone / n, float(np.log1p(len(words))),
    ]


def featurise(docs: DataFrame, learnt: frozenset[str]) -> DataFrame:
    """The columns of ``docs`` without text, and features array<double>."""
    shipped = common.Shipped(docs.sparkSession, learnt)
    keep = [c for c in docs.columns if c not in ("text", "features")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shipped.get()
        for batch in batches:
            rows = [features(x.as_py(), words) for x in batch.column(batch.schema.get_field_index("text"))]
            index = [batch.schema.get_field_index(k) for k in keep]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in index), pa.array(rows, pa.list_(pa.float64()))], [*keep, "features"])

    return docs.select(*keep, "text").mapInArrow(run, common.extended(docs.select(*keep), "features array<double>"))


def learn_lexicon(sample: DataFrame) -> frozenset[str]:
    """Words that are in many more toxic documents of the sample (text, _op_label) than in others; counted in Spark, only those that are kept come here."""
    n = {r[0]: r[1] for r in sample.groupBy("_op_label").count().collect()}  # two rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen.update((w, label) for w in set(tokens(text.as_py() or "")))
            words = [w for w, _ in seen]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([y for _, y in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["word", "label", "n"])

    seen = sample.select("text", F.col("_op_label").cast("int")).mapInArrow(run, "word string, label int, n long")
    by = seen.groupBy("word").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("c"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("o"))
    odds = F.log((F.col("c") + 0.5) / (n.get(1, 0) + 1)) - F.log((F.col("o") + 0.5) / (n.get(0, 0) + 1))
    kept = by.where(F.col("c") >= SUPPORT).withColumn("odds", odds).where(F.col("odds") >= LOG_ODDS).where(~F.col("word").isin(*sorted(INSULTS)))
    return frozenset(r.word for r in kept.orderBy(F.desc("odds"), "word").limit(LEARNT).collect())


class Fitted:
    """Lexicon, trees and calibration; or only the share of toxic rows where the labels are all alike."""

    def __init__(self, learnt: frozenset[str], trees, calibration, share: float) -> None:
        self.learnt, self.trees, self.calibration, self.share = learnt, trees, calibration, share

    def score(self, docs: DataFrame) -> DataFrame:
        """The columns of ``docs`` without text, and score double."""
        keep = [c for c in docs.columns if c not in ("text", "score")]
        if self.trees is None:
            return docs.select(*keep, F.lit(self.share).alias("score"))
        found = featurise(docs.select(*[c for c in docs.columns if c != "score"]), self.learnt).withColumn("_op_v", array_to_vector("features"))
        margin = self.trees.transform(found).withColumn("_op_margin", vector_to_array("_op_raw")[1])
        return self.calibration.transform(margin).select(*keep, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_op_score"))).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Fitted:
    """Learn from documents (doc_id, text) that have a label (doc_id, toxic)."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_op_label"))
    chance = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    total = known.count()
    picked = known.where(chance * total < sample_rows).withColumn("_op_part", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("part")), F.lit(10)))
    # at most about sample_rows small rows: safe to broadcast
    own = common.materialise(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), "toxicity-own")
    # an id may have many rows: equal ones count once, and of all that are there about sample_rows are taken
    key = F.xxhash64(F.col("doc_id").cast("string"), F.coalesce(F.col("text"), F.lit("")))
    rows = own.count()
    some = own.where(F.pmod(key, F.lit(1 << 30)) / F.lit(float(1 << 30)) * rows < sample_rows) if rows > sample_rows else own
    sample = common.materialise(some.withColumn("_op_key", key).dropDuplicates(["doc_id", "_op_key"]).drop("_op_key"), "toxicity-sample")
    trees_part = F.col("_op_part") >= CALIBRATION
    counts = {r[0]: r[1] for r in sample.groupBy("_op_label").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(counts) < 2 or sample.where(trees_part).select("_op_label").distinct().count() < 2:
        return Fitted(frozenset(), None, None, share)
    learnt = learn_lexicon(sample.where(trees_part).select("text", "_op_label"))
    ready = common.materialise(featurise(sample, learnt), "toxicity-features").withColumn("_op_v", array_to_vector("features")).withColumn("_op_y", F.col("_op_label").cast("double")).repartition(4)
    trees = GBTClassifier(featuresCol="_op_v", labelCol="_op_y", maxIter=TREES, maxDepth=DEPTH, seed=7)
    trees = trees.setRawPredictionCol("_op_raw").setProbabilityCol("_op_prob").setPredictionCol("_op_class").fit(ready.where(trees_part))
    held = ready.where(~trees_part)
    if held.limit(1).count() == 0:
        held = ready
    margin = trees.transform(held).withColumn("_op_margin", vector_to_array("_op_raw")[1])
    calibration = IsotonicRegression(featuresCol="_op_margin", labelCol="_op_y", predictionCol="_op_score").fit(margin)
    return Fitted(learnt, trees, calibration, share)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learnt from the rows that are not held out."""
    held = common.remainder("doc_id", 5) == 0
    model = fit(docs.where(~held), labels.where(~held))
    scored = model.score(docs.select("doc_id", held.alias("held_out"), "text"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
