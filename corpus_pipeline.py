"""The corpus pipeline: documents in, shards of a clean, mixed corpus out.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame
that is written as Parquet and read again as the next one's docs.  All stages but the last return the
columns of ``documents``:

1. ``language``: documents without a letter, or without a language that is likelier than not, go;
   the model learns from the labelled documents at hand.  Null text goes.
2. ``near_duplicates``: five-word shingles, similarity 0.8 or more; of each group one document stays.
3. ``decontaminate``: documents with a twentieth or more of their words in benchmark windows go.
4. ``mix``: sources repeat or thin out towards their target shares, in a global shuffle.
5. ``shard``: every copy gets a shard and a place in it.

Repeated ids are possible after ``mix`` (copies); an empty table passes through all stages.

Stages with Python set Arrow batches to 1000 rows at most (``common.small_batches``); ``run`` sets them back.
"""

from __future__ import annotations

from contextlib import ExitStack

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.llm import common, decontamination, language, mixing, ngramjoin, sharding

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.5
SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    found = language.predict(docs.select(*DOCUMENTS), language.fit(docs))
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*DOCUMENTS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return ngramjoin.keep_one(docs.select(*DOCUMENTS), SHINGLE_WORDS, SIMILARITY_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return decontamination.clean(docs.select(*DOCUMENTS), common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs.select(*DOCUMENTS)).select(*DOCUMENTS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs.select(*DOCUMENTS))


STAGES = [("language", identify), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: SQL cannot express the language model; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's result is written to shared storage and read again.

    What a stage wrote goes when the next one has written; the result is written, too."""
    docs = common.table(spark, sf_dir, "documents")
    with ExitStack() as session, ExitStack() as stack:
        session.callback(spark.conf.set, common.BATCH_ROWS, common.small_batches(spark))
        for name, stage in STAGES[:-1]:
            with stack.pop_all():
                work = stack.enter_context(common.Workspace(spark, f"pipeline-{name}"))
                docs = work.write(stage(spark, docs, sf_dir), name)
        name, stage = STAGES[-1]
        return common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
