import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.llm import common, language, lm, toxicity

from .conftest import rows_of

DATA = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


# --- language --------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    docs = table(spark, "documents")
    found = language.report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.98
    assert found.where("score < 0 or score > 1").count() == 0


def test_language_cases(docs):
    rows = [(3 * i, "the house and the garden " * 3, "en") for i in range(30)] + [(3 * i + 1, "la maison et le jardin " * 3, "fr") for i in range(60)]
    rows += [(1000, None, None), (1001, "", "en"), (1002, "123 ... !!", "fr"), (1003, "½ ²", "en"), (1004, "jardins", None), (1005, "the " * 50_000, None), (1005, "the " * 50_000, None)]
    model = language.fit(docs(*rows).where("lang is not null"))
    got = dict((r.doc_id, (r.lang_pred, r.score)) for r in language.predict(docs(*rows), model).where("doc_id >= 1000").collect())
    assert {i: got[i][0] for i in range(1000, 1004)} == {i: "und" for i in range(1000, 1004)}
    assert got[1000][1] == 0 and got[1004][0] == "fr" and got[1005][0] == "en"
    assert language.report(docs().limit(0)).count() == 0
    nothing = language.predict(docs((1, "text")), language.fit(docs((1, "text", None))))
    assert rows_of(nothing, "lang_pred", "score") == [("und", 0.0)]


def test_language_sample_is_bounded_by_rows(docs):
    """One id, or null ids, on all rows: the bound is on different rows, and every language is learnt."""
    spelt = lambda k: "".join(chr(97 + int(d)) for d in str(k))
    for i in (7, None):
        rows = [(i, f"das wort{spelt(k)} haus", "de") for k in range(3000)] + [(i, f"the word{spelt(k)} house", "en") for k in range(20)] + [(i, "le mot", "fr")] * 3000
        model = language.fit(docs(*rows), 300)
        assert model.langs == ["de", "en", "fr"] and 200 < len(model.index[0]) < 450
        assert model.predict("das haus")[0] == "de" and model.predict("le mot")[0] == "fr"
    many = [(k, f"w{k}x{j}", f"l{k:04}") for k in range(600) for j in range(2)]
    assert len(language.fit(docs(*many)).langs) == 600


def test_toxicity_sample_is_bounded_by_rows(spark, docs):
    """One labelled id with many rows: equal texts count once, and of others no more than the bound are learnt from."""
    rows = [(1, f"you are vile{k % 9} {k}") for k in range(800)] + [(1, "you are vile") for _ in range(400)] + [(10 + k, f"a calm day {k}") for k in range(60)]
    labels = spark.createDataFrame([(1, 1), *((10 + k, 0) for k in range(60))], "doc_id long, toxic int")
    seen = []
    original = toxicity.learn_lexicon
    toxicity.learn_lexicon = lambda sample: seen.append(sample.count()) or original(sample)
    try:
        model = toxicity.fit(docs(*rows), labels, 200)
    finally:
        toxicity.learn_lexicon = original
    assert all(n <= 300 for n in seen)
    assert model.score(docs((5, "you are vile1"))).count() == 1


def test_backoff_goes_from_words_to_shorter_grams():
    rows = [("en", 0, "house", 5), ("fr", 0, "maison", 5), ("en", 3, "hou", 5), ("fr", 2, "ma", 5), ("fr", 1, "m", 5), ("en", 1, "h", 4), ("en", 1, "m", 1)]
    totals = {(lang, k): 10 for lang, k, _, _ in rows}
    m = language.Model(["en", "fr"], rows, totals)
    assert m.word("house").tolist() == pytest.approx([-math.log10(0.5), language.PENALTY])  # the word itself
    assert m.word("hours").tolist() == pytest.approx([-math.log10(0.5), language.PENALTY])  # its three letters
    assert m.word("mare").tolist() == pytest.approx([language.PENALTY, -math.log10(0.5)])  # two letters
    assert m.word("xm").tolist() == pytest.approx([-math.log10(0.1), -math.log10(0.5)])  # one letter
    assert m.word("zzz").tolist() == [language.PENALTY] * 2


# --- toxicity --------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    labels = table(spark, "labels")
    found = toxicity.report(table(spark, "documents"), labels)
    assert found.count() == 1000 and found.where("score is null or score < 0 or score > 1").count() == 0
    assert found.where("predicted <> cast(score >= 0.5 as int)").count() == 0
    r = found.join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    hit = sum(x.toxic and x.predicted for x in r)
    assert hit >= 0.6 * sum(x.toxic for x in r) and hit >= 0.8 * sum(x.predicted for x in r)


def test_toxicity_cases(spark, docs):
    d = docs((1, "you are an idiot"), (2, None), (3, ""), (3, ""), (4, "!" * 100_000), (5, "YOU id10t m*ron"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rows_of(toxicity.report(d, none), "predicted") == [(0,)] * 6
    only = spark.createDataFrame([(1, 0, 1), (2, 0, 1), (3, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.report(d, only).collect()} <= {0.0, 1.0}
    assert toxicity.report(d.limit(0), only).count() == 0


def test_toxicity_features():
    f = dict(zip(toxicity.FEATURES, toxicity.features("YOU are an idiot! id1ot ab", frozenset(["ab"])), strict=True))
    assert f["insults"] == pytest.approx(1 / 6) and f["learnt"] == pytest.approx(1 / 6) and f["near_second"] > 0
    assert f["masked"] == pytest.approx(1 / 6) and f["unmasked"] == pytest.approx(1 / 6) and f["shouted"] == pytest.approx(1 / 6)


# --- language model ------------------------------------------------------------------------------------------


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w] + ["\0end"]


def check_counts(texts, got):
    train = collections.Counter()
    for i, t in texts:
        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            train.update(tokens(t))
    n, v = sum(train.values()), len(train)
    want = sorted((i, len(w := tokens(t)), sum(train[x] > 0 for x in w), n, round(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w), 4)) for i, t in texts)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want


def test_lm_counts_and_cases(docs):
    texts = [(i, f"the cat {i} sat on the mat") for i in range(20)] + [(50, None), (51, ""), (52, "  \t\n "), (53, "ÉCOLE Éa b"), (54, "word " * 40_000), (54, "word")]
    got = lm.report(docs(*texts)).collect()
    check_counts(texts, got)
    assert all(r.score < 0 and math.isfinite(r.perplexity) for r in got)
    assert lm.report(docs().limit(0)).count() == 0
    assert lm.report(docs((2, "only held out"), (9, "x"))).count() == 2
    assert [r.doc_id for r in lm.report(docs((None, "a b"))).collect()] == [None]


def test_lm_many_batches_and_parts_agree_with_one(docs, monkeypatch):
    texts = [(i, " ".join(f"w{(i * k) % 37}" for k in range(60))) for i in range(40)]
    whole = rows_of(lm.report(docs(*texts)), "doc_id", "n_known", "base_score")
    monkeypatch.setattr(lm, "BATCH_TOKENS", 100)
    monkeypatch.setattr(lm, "PART_PAIRS", 50)
    assert [r[:2] for r in rows_of(lm.report(docs(*texts)), "doc_id", "n_known", "base_score")] == [r[:2] for r in whole]


def test_lm_beats_the_smoothed_unigrams_on_held_out_text(spark):
    r = lm.report(table(spark, "documents")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_lm_is_a_distribution():
    """Probabilities of all known words and one unknown sum to one in each context."""
    word = np.repeat(np.arange(1, 51, dtype=np.uint64), 2)
    context = np.tile(np.array([0, 1], np.uint16), 50)
    n = np.random.default_rng(1).integers(0, 9, 100)
    n[::2] += 1
    part = lm.Part(word, context, n, 0)
    for s in range(3):
        part.sweep(lm.Totals(part.totals()), s)
    t = lm.Totals(part.totals())
    p = part.predictive(t)
    unknown = t.root(np.zeros(1), np.zeros(1))[0]
    for c in (0, 1):
        rest = (lm.STRENGTH + t.discount * t.tables[c]) / (lm.STRENGTH + t.customers[c])
        assert p[context == c].sum() + rest * unknown == pytest.approx(1, abs=1e-6)
    assert (part.tables <= part.n).all() and ((part.tables > 0) == (part.n > 0)).all()


def test_word_hashes_do_not_depend_on_place():
    a, _, _ = lm.words_of([b"one two", b"", b"two\tONE"])
    assert a[0] == a[5] and a[1] == a[4] and a[2] == a[3] == a[6] == lm.END
    assert common.hash_words(common.as_bytes("X y"))[0] == common.hash_words(common.as_bytes("  x"))[0]
