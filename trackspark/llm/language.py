"""Operator 3: language identification, words first with backoff to shorter character n-grams.

For each language the model has relative frequencies of words and of character n-grams.  A word that
any language knows is scored by its log frequency in each language (a penalty where one lacks it).  A
word that none knows falls back to the n-grams of the longest order of which at least one is known:
its score is the mean over those.  A document's score is the mean over its words; the lowest wins.

Fitting takes a bounded sample: about ``SAMPLE_DOCS`` different documents of each language (fewer, if
there are so many languages that they pass ``SAMPLE_ALL``), chosen by a hash of id and text, with their whole texts; equal rows count once.
The model keeps the ``VOCABULARY`` most frequent words and ``NGRAMS`` most frequent n-grams of each order and language, or
fewer of each where all languages together pass ``MODEL_CELLS`` numbers; no language is left out.  These parameters bound what is broadcast
(a few MB for a handful of languages), whatever the size of the corpus.  Prediction covers every
document, whole.

Cases: null text or text without a letter gives ``und`` with score 0; without any labelled document
all is ``und``; ties go to the language first in order; repeated rows are scored alike; other columns
pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

UNKNOWN = "und"
ORDERS = (4, 3, 2, 1)
SAMPLE_DOCS = 3000
VOCABULARY = 30_000
NGRAMS = 8_000
#: Minus log10 of the frequency that a language is given for what it lacks.
PENALTY = 7.0
#: Documents and numbers of a model over all languages.
SAMPLE_ALL = 1_500_000
MODEL_CELLS = 100_000_000
#: Languages whose sizes, of 16 bytes each, are broadcast.
BROADCAST_LANGUAGES = 100_000
MEMO = 400_000

_WORD = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> list[str]:
    """The words of a text: runs of letters, lower-cased."""
    if not text:
        return []
    found = _WORD.findall(text.lower())
    return found if all(map(str.isalpha, found)) else [w for x in found if (w := "".join(filter(str.isalpha, x)))]


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, order (0: word), gram, n: summed per batch of documents."""
    for batch in batches:
        by: dict[str, Counter] = {}
        for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
            by.setdefault(lang.as_py(), Counter()).update(letters(text.as_py()))
        rows = []
        for lang, seen in by.items():
            tally: dict[tuple[int, str], int] = Counter()
            for word, n in seen.items():
                tally[0, word] += n
                for order in ORDERS:
                    for g in grams(word, order):
                        tally[order, g] += n
            rows += [(lang, order, g, n) for (order, g), n in tally.items()]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "kind", "gram", "n"])


class Model:
    """Word and n-gram scores: a row of minus log10 frequencies per language for each known gram."""

    def __init__(self, langs: list[str], rows: list[tuple[str, int, str, int]], totals: dict[tuple[str, int], int]) -> None:
        self.langs = langs
        at = {x: i for i, x in enumerate(langs)}
        self.index: dict[int, dict[str, int]] = {k: {} for k in (0, *ORDERS)}
        self.table = np.full((len({(k, g) for _, k, g, _ in rows}), len(langs)), PENALTY)
        for lang, kind, gram, n in rows:
            i = self.index[kind].setdefault(gram, sum(map(len, self.index.values())) if gram not in self.index[kind] else 0)
            self.table[i, at[lang]] = min(PENALTY, -np.log10(n / totals[lang, kind]))
        self._reset()

    def _reset(self) -> None:
        self.memo: dict[str, int] = {}
        self.scores = np.empty((1024, len(self.langs)))

    def __getstate__(self):
        return {"langs": self.langs, "index": self.index, "table": self.table}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self._reset()

    def word(self, word: str) -> np.ndarray:
        """Scores of one word, by backoff."""
        if (i := self.index[0].get(word)) is not None:
            return self.table[i]
        for order in ORDERS:
            known = self.index[order]
            if found := [i for g in grams(word, order) if (i := known.get(g)) is not None]:
                return self.table[found].mean(0)
        return np.full(len(self.langs), PENALTY)

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter(letters(text))
        if not counts or not self.langs:
            return UNKNOWN, 0.0
        if len(self.memo) > MEMO:
            self._reset()
        memo = self.memo
        ids = []
        for w in counts:
            i = memo.get(w)
            if i is None:
                i = memo[w] = len(memo)
                if i >= len(self.scores):
                    self.scores = np.concatenate([self.scores, np.empty_like(self.scores)])
                self.scores[i] = self.word(w)
            ids.append(i)
        n = np.fromiter(counts.values(), float, len(counts))
        mean = n @ self.scores[ids] / n.sum()
        best = int(mean.argmin())
        # how much likelier than the others, for as many words, but no surer than 100 words make it
        gap = (mean - mean[best]) * np.log(10) * min(n.sum(), 100.0)
        return self.langs[best], float(1 / np.exp(-gap).sum())


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, vocabulary: int = VOCABULARY, ngrams: int = NGRAMS) -> Model:
    """A model from text and lang of a bounded sample of ``labelled``; rows without lang are left out."""
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit("")))
    rows = labelled.where(F.col("lang").isNotNull()).select("text", "lang", key.alias("_op_key"), F.xxhash64("lang").alias("_op_lang"))
    sizes = rows.groupBy("_op_lang").agg(F.approx_count_distinct("_op_key", 0.02).alias("_op_n"))
    langs = sizes.count()
    per_lang = max(1, min(sample_docs, SAMPLE_ALL // max(1, langs)))
    grams_each = max(1, MODEL_CELLS // max(1, langs * langs))
    share = min(1.0, grams_each / (vocabulary + len(ORDERS) * ngrams))
    vocabulary, ngrams = max(1, int(vocabulary * share)), max(1, int(ngrams * share))
    chance = F.pmod(F.col("_op_key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # two numbers a language: texts stay where they are, unless there are too many languages, when Spark splits what is skewed
    sample = rows.join(F.broadcast(sizes) if langs <= BROADCAST_LANGUAGES else sizes, "_op_lang").where(chance * F.col("_op_n") < per_lang).groupBy("lang", "_op_key").agg(F.first("text").alias("text")).select("text", "lang")
    tally = sample.mapInArrow(_count, "lang string, kind int, gram string, n long").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("lang", "kind")
    kept = (
        tally.withColumn("total", F.sum("n").over(by))
        .withColumn("rank", F.row_number().over(by.orderBy(F.desc("n"), "gram")))
        .where(F.col("rank") <= F.when(F.col("kind") == 0, vocabulary).otherwise(ngrams))
        .select("lang", "kind", "gram", "n", "total")
        .toArrow()
    )
    columns = [kept.column(c).to_pylist() for c in ("lang", "kind", "gram", "n", "total")]
    totals = {(lang, kind): total for lang, kind, _, _, total in zip(*columns, strict=True)}
    return Model(sorted(set(columns[0])), list(zip(*columns[:4], strict=True)), totals)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` with lang_pred and score (such columns of the input are replaced)."""
    docs = docs.drop("lang_pred", "score")
    shipped = common.Shipped(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.get()
        for batch in batches:
            found = [own.predict(x.as_py()) for x in batch.column(batch.schema.get_field_index("text"))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                [*batch.schema.names, "lang_pred", "score"],
            )

    return docs.mapInArrow(run, common.extended(docs, "lang_pred string, score double"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt from the rows that are not held out."""
    held = common.remainder("doc_id", 3) == 1
    model = fit(docs.where(~held))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
