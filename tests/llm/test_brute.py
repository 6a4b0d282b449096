"""Operators that SQL cannot express, against plain versions that share no code with them."""

import collections
import hashlib
import math
import random
import re
import unicodedata

import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from trackspark.llm import language, lm, mixing, toxicity

DATA = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


# --- language ----------------------------------------------------------------------------------------------


def letter_words(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if unicodedata.category(c).startswith("L"):
            word += c
        elif re.match(r"[^\W\d_]", c):
            continue  # a word character that is no letter, as a mark that lower-casing leaves
        elif word:
            out.append(word)
            word = ""
    return out


class PlainLanguage:
    """Frequencies of words and character n-grams of all labelled texts, scored word by word."""

    def __init__(self, rows):
        self.count = collections.defaultdict(collections.Counter)
        for text, lang in rows:
            for w in letter_words(text):
                self.count[lang, 0][w] += 1
                for n in (1, 2, 3, 4):
                    p = f" {w} "
                    for i in range(len(p) - n + 1):
                        self.count[lang, n][p[i : i + n]] += 1
        self.langs = sorted({lang for lang, _ in self.count})
        self.total = {k: sum(c.values()) for k, c in self.count.items()}
        self.seen = {}

    def cost(self, lang, n, gram):
        c = self.count[lang, n]
        return min(7.0, -math.log10(c[gram] / self.total[lang, n])) if gram in c else 7.0

    def word(self, w):
        if any(w in self.count[x, 0] for x in self.langs):
            return [self.cost(x, 0, w) for x in self.langs]
        p = f" {w} "
        for n in (4, 3, 2, 1):
            known = [g for i in range(len(p) - n + 1) if any((g := p[i : i + n]) in self.count[x, n] for x in self.langs)]
            if known:
                return [sum(self.cost(x, n, g) for g in known) / len(known) for x in self.langs]
        return [7.0] * len(self.langs)

    def predict(self, text):
        words = collections.Counter(letter_words(text))
        if not words:
            return "und", 0.0
        n = sum(words.values())
        sums = [0.0] * len(self.langs)
        for w, k in words.items():
            if w not in self.seen:
                self.seen[w] = self.word(w)
            sums = [s + k * x for s, x in zip(sums, self.seen[w], strict=True)]
        mean = [s / n for s in sums]
        best = mean.index(min(mean))
        return self.langs[best], 1 / sum(math.exp(-(m - mean[best]) * math.log(10) * min(n, 100)) for m in mean)


def test_language_against_a_plain_model(spark):
    """All words and n-grams of so small a table are within the model's bounds, so both learn the same."""
    docs = table(spark, "documents").where("length(text) < 3000")
    rows = docs.collect()
    known = [(r.text, r.lang) for r in rows if r.lang is not None]
    plain = PlainLanguage(known)
    model = language.fit(docs, vocabulary=10**7, ngrams=10**7)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, model).collect()}
    assert len(got) > 100
    for r in rows:
        lang, score = plain.predict(r.text)
        assert got[r.doc_id][0] == lang and got[r.doc_id][1] == pytest.approx(score, abs=1e-9), r.doc_id


def test_language_ties_go_to_the_first(docs):
    model = language.fit(docs((1, "same words here", "fr"), (2, "same words here", "de")))
    assert [r.lang_pred for r in language.predict(docs((9, "same words")), model).collect()] == ["de"]


# --- toxicity ------------------------------------------------------------------------------------------------


def plain_features(text, learnt):
    words = re.findall(r"[\w@$*!]+", (text or "").lower())
    n, size = max(1, len(words)), max(1, len((text or "").encode()))
    bad = [i for i, w in enumerate(words) if w in toxicity.INSULTS or w.strip("!*$@") in toxicity.INSULTS]
    more = [i for i, w in enumerate(words) if w in learnt]
    you = [i for i, w in enumerate(words) if w in toxicity.SECOND]
    near = sum(any(abs(i - j) <= toxicity.NEAR for j in you) for i in {*bad, *more})
    masked = re.findall(r"[^\W\d_][\d@$*!]+[^\W\d_]", text or "")
    fixed = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "_": ""}
    undone = [w for w in words if not w.isalpha() and w not in toxicity.INSULTS and "".join(fixed.get(c, c) for c in w) in toxicity.INSULTS] if masked or bad else []
    ascii_ = [c for c in text or "" if ord(c) < 128]
    shouted = re.findall(r"\b[A-Z]{3,}\b", text or "") if sum("A" <= c <= "Z" for c in ascii_) > 2 else []
    bang = sum(c in "!?" for c in ascii_)
    signs = sum(c in "\"#$%&'()*+,-./:;<=>@[\\]^_`{|}~" for c in ascii_)
    return [
        len(bad) / n, len(more) / n, len({words[i] for i in bad}), len({words[i] for i in more}), near / n, len(you) / n,
        sum("A" <= c <= "Z" for c in ascii_) / size, len(shouted) / n, signs / size, bang / size, len(masked) / n, len(undone) / n, math.log1p(len(words)),
    ]


def test_toxicity_against_plain_features_and_a_walk_of_the_trees(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    model = toxicity.fit(docs, labels)
    rows = {r.doc_id: plain_features(r.text, model.learnt) for r in docs.collect()}
    got = {r.doc_id: r.features for r in toxicity.featurise(docs, model.learnt).collect()}
    for i, want in rows.items():
        assert got[i] == pytest.approx(want, abs=1e-9), i
    if model.trees is None:
        return

    def walk(node, x):
        while node.numDescendants():
            at, split = node.split().featureIndex(), node.split()
            node = node.leftChild() if x[at] <= split.threshold() else node.rightChild()
        return node.prediction()

    roots = [t._java_obj.rootNode() for t in model.trees.trees]
    weights = list(model.trees.treeWeights)
    bounds, values = list(model.calibration.boundaries), list(model.calibration.predictions)

    def calibrated(m):
        if m <= bounds[0]:
            return values[0]
        for (a, x), (b, y) in zip(zip(bounds, values, strict=True), list(zip(bounds, values, strict=True))[1:]):
            if m <= b:
                return y if b == a else x + (y - x) * (m - a) / (b - a)
        return values[-1]

    sample = sorted(rows)[:60]
    frame = spark.createDataFrame([(i, list(map(float, rows[i]))) for i in sample], "doc_id long, f array<double>").withColumn("_op_v", array_to_vector("f"))
    raw = {r.doc_id: r.m for r in model.trees.transform(frame).select("doc_id", vector_to_array("_op_raw")[1].alias("m")).collect()}
    scores = {r.doc_id: r.score for r in model.score(docs.select("doc_id", "text")).collect()}
    for i in sample:
        margin = sum(w * walk(t, rows[i]) for t, w in zip(roots, weights, strict=True))
        assert raw[i] == pytest.approx(margin, abs=1e-6)
        assert scores[i] == pytest.approx(min(1, max(0, calibrated(raw[i]))), abs=1e-6)


# --- language model ---------------------------------------------------------------------------------------------


def gibbs(train, asked, sweeps=160, burn=40):
    """Mean log10 probability of texts under the two-level process, customer by customer, tables kept one by one."""
    rng = random.Random(4)
    pairs = [(c, w) for text in train for c, w in zip(["<s>", *text], [*text, "</s>"], strict=True)]
    words = sorted({w for _, w in pairs})
    base = 1 / (len(words) + 1)
    n = collections.Counter(pairs)
    share = lambda one, two: min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.5
    d = share(sum(k == 1 for k in n.values()), sum(k == 2 for k in n.values()))
    seats = collections.defaultdict(list)  # (context, word) -> sizes of tables
    root = collections.defaultdict(list)  # word -> sizes of tables; its customers are the tables above

    def root_p(w, rd):
        c, t = sum(map(sum, root.values())), sum(map(len, root.values()))
        return (max(0, sum(root[w]) - rd * len(root[w])) + (lm.ROOT_STRENGTH + rd * t) * base) / (lm.ROOT_STRENGTH + c)

    def root_d():
        k = collections.Counter(sum(v) for v in root.values())
        return share(k[1], k[2])

    def choose(weights):
        x = rng.random() * sum(weights)
        for i, w in enumerate(weights):
            x -= w
            if x <= 0:
                return i
        return len(weights) - 1

    def enter_root(w, rd):
        t = sum(map(len, root.values()))
        i = choose([*(k - rd for k in root[w]), (lm.ROOT_STRENGTH + rd * t) * base])
        if i == len(root[w]):
            root[w].append(0)
        root[w][i] += 1

    def enter(c, w, rd):
        t = sum(len(v) for (x, _), v in seats.items() if x == c)
        i = choose([*(k - d for k in seats[c, w]), (lm.STRENGTH + d * t) * root_p(w, rd)])
        if i == len(seats[c, w]):
            seats[c, w].append(0)
            enter_root(w, rd)
        seats[c, w][i] += 1

    def leave(table):
        i = choose(table)
        table[i] -= 1
        if not table[i]:
            del table[i]
            return True
        return False

    for c, w in pairs:
        enter(c, w, root_d())
    total, mean = 0, collections.Counter()
    for s in range(sweeps):
        for c, w in pairs:
            if leave(seats[c, w]):
                leave(root[w])
            enter(c, w, root_d())
        if s >= burn:
            total += 1
            rd = root_d()
            for c, w in {(c, w) for text in asked for c, w in zip(["<s>", *text], [*text, "</s>"], strict=True)}:
                k, t = sum(n[c, x] for x in words), sum(len(v) for (x, _), v in seats.items() if x == c)
                p = (max(0, n[c, w] - d * len(seats[c, w])) + (lm.STRENGTH + d * t) * root_p(w, rd)) / (lm.STRENGTH + k)
                mean[c, w] += p
    return [sum(math.log10(mean[c, w] / total) for c, w in zip(["<s>", *text], [*text, "</s>"], strict=True)) for text in asked]


def test_language_model_agrees_with_seating_customer_by_customer(docs, monkeypatch):
    """More sweeps than in production, so that the noise of two samples does not hide a difference."""
    monkeypatch.setattr(lm, "SWEEPS", 14)
    monkeypatch.setattr(lm, "BURN_IN", 4)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(12)]
    follow = {w: rng.sample(words, 3) for w in words}
    train = []
    for _ in range(40):
        text = [rng.choice(words[:4])]
        while len(text) < 8:
            text.append(rng.choice(follow[text[-1]]) if rng.random() < 0.8 else rng.choice(words))
        train.append(text)
    asked = [*train[:6], ["w1", "w5", "w9"], ["new", "w2"], []]
    rows = [(i, " ".join(t)) for i, t in enumerate(train)] + [(1000 + i, " ".join(t)) for i, t in enumerate(asked)]
    got = {r.doc_id: r.score for r in lm.score(docs(*rows), F.col("doc_id") >= 1000).collect()}
    want = gibbs(train, asked)
    for i, x in enumerate(want):
        assert got[1000 + i] == pytest.approx(x, rel=0.03, abs=0.05), asked[i]


# --- mixing -------------------------------------------------------------------------------------------------------


def test_copies_follow_the_poisson_law(docs):
    """Chi-square of the number of copies per document against the law, at three rates."""
    source = docs(*[(i, f"text {i}", "en", s) for i in range(9000) for s in [("a", "b", "c")[i % 3]]])
    out = mixing.mix(source, {"a": 1.0, "b": 2.0, "c": 6.0}, rows=9000)
    rates = {"a": 1000 / 3000, "b": 2000 / 3000, "c": 6000 / 3000}
    n = collections.Counter((r.source, r.doc_id) for r in out.select("source", "doc_id").collect())
    for k, (s, rate) in enumerate(rates.items()):
        seen = collections.Counter(min(6, n[s, i]) for i in range(k, 9000, 3))
        law = [math.exp(-rate) * rate**j / math.factorial(j) for j in range(6)]
        law.append(1 - sum(law))
        expected = [3000 * p for p in law]
        groups = [(seen[j], e) for j, e in enumerate(expected) if e >= 5]
        assert sum((a - e) ** 2 / e for a, e in groups) < 25, (s, seen)  # one in some thousands for six degrees of freedom


def test_copies_follow_the_poisson_law_at_high_rates(docs):
    """Means of several draws: mean, variance and chi-square against the law at 40 and 100."""
    source = docs(*[(i, f"text {i}", "en", "ab"[i % 2]) for i in range(6000)])
    out = mixing.mix(source, {"a": 40.0, "b": 100.0}, rows=3000 * 140)
    n = {(r.source, r.doc_id): r["count"] for r in out.groupBy("source", "doc_id").count().collect()}
    for k, (s, rate) in enumerate((("a", 40), ("b", 100))):
        seen = [n.get((s, i), 0) for i in range(k, 6000, 2)]
        mean = sum(seen) / 3000
        assert abs(mean - rate) < 5 * math.sqrt(rate / 3000) and abs(sum((x - mean) ** 2 for x in seen) / 3000 / rate - 1) < 5 * math.sqrt(2 / 3000)
        edges = [rate + round(z * math.sqrt(rate)) for z in (-1.5, -1, -0.5, 0, 0.5, 1, 1.5)]
        below = [sum(math.exp(j * math.log(rate) - rate - math.lgamma(j + 1)) for j in range(e)) for e in edges]
        law = [b - a for a, b in zip([0, *below], [*below, 1], strict=True)]
        counts = collections.Counter(sum(x >= e for e in edges) for x in seen)
        assert sum((counts[j] - 3000 * p) ** 2 / (3000 * p) for j, p in enumerate(law)) < 29, s  # one in some ten thousands


def test_copies_by_hand(docs):
    """The count of a document follows from a hash of the seed, the id and the text, looked up in the law."""
    rows = [(i, f"text {i}", "en", "a") for i in range(200)]
    out = collections.Counter(r.doc_id for r in mixing.mix(docs(*rows), {"a": 1.0}, rows=500).collect())
    for i, text, *_ in rows:
        ident = f"{mixing.SEED}|{i}|{hashlib.md5(text.encode()).hexdigest()}"
        u = int(hashlib.md5(ident.encode()).hexdigest()[:8], 16) / 2**32
        k, p = 0, math.exp(-2.5)
        c = p
        while c <= u:
            k += 1
            p *= 2.5 / k
            c += p
        assert out[i] == k
