"""Every word before another is a context of its own, also rare ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.llm import lm


def test_rare_contexts_with_one_ending_are_kept_apart(docs):
    common_words = " ".join(f"w{i} w{i}" for i in range(300)) + " "
    train = [(i, common_words * 5) for i in range(4)] + [(10 + i, "pecan alpha") for i in range(8)] + [(20 + i, "toucan beta") for i in range(8)]
    asked = [(1000, "pecan alpha"), (1001, "pecan beta"), (1002, "toucan alpha"), (1003, "toucan beta"), (1004, "unseen beta")]
    got = {r.doc_id: r.score for r in lm.score(docs(*train, *asked), F.col("doc_id") >= 1000).collect()}
    assert got[1000] > got[1001] + 0.5 and got[1003] > got[1002] + 0.5


def test_hot_words_dealt_over_parts_are_a_distribution():
    """Two parts that share hot words, exchanged by hand: probabilities in a context sum to one."""
    rng = np.random.default_rng(3)
    word, context = (x.ravel() for x in np.meshgrid(np.arange(1, 41, dtype=np.uint64), np.arange(3, dtype=np.uint64), indexing="ij"))
    n, hot = rng.integers(1, 9, 120), np.arange(1, 6, dtype=np.uint64)
    of = np.where(word <= 5, context % 2, word % 2)
    parts = [lm.Part(word[of == p], context[of == p], n[of == p], p, hot) for p in (0, 1)]
    before = None
    for s in range(3):
        overall, of_hot = sum(p.overall() for p in parts), sum(p.of_hot() for p in parts)
        sat, count = of_hot.reshape(2, -1).astype(np.int64)
        tables = (count > 0).astype(np.int64) if before is None else before.seat_root(sat, np.random.default_rng(s))
        overall += 0, tables.sum(), (count > 0).sum(), 0, 0, (sat == 1).sum(), (sat == 2).sum()
        customers, seated = (np.array([sum(p.per_context()[k][p.contexts == c].sum() for p in parts) for c in range(3)]) for k in (0, 1))
        totals = [lm.Totals(np.concatenate([customers[p.contexts.astype(int)], seated[p.contexts.astype(int)], overall]), np.concatenate([sat, count, tables])) for p in parts]
        of_context = [sum(p.predictive(t)[p.contexts[p.context] == c].sum() for p, t in zip(parts, totals, strict=True)) for c in range(3)]
        t = totals[0]
        unknown = t.root(np.zeros(1), np.zeros(1))[0]
        for c in range(3):
            rest = (lm.STRENGTH + t.discount * seated[c]) / (lm.STRENGTH + customers[c])
            assert of_context[c] + rest * unknown == pytest.approx(1, abs=1e-6)
        before = t
        for p, t in zip(parts, totals, strict=True):
            p.sweep(t, s)


def test_counts_beyond_32_bits_come_through():
    """Customers of a context and tables, sent from parts to buckets and back."""
    for x in ([], [0, 5], [5_000_000_000], [2**32 - 1, 2**32, 1]):
        assert lm._read_counts(lm._counts(np.array(x, np.int64))).tolist() == x
    word, context, n = np.array([1, 2, 3], np.uint64), np.array([7, 7, 9], np.uint64), np.array([5_000_000_000, 4, 3])
    part = lm.Part(word, context, n, 0, np.zeros(0, np.uint64))
    rows = lm._send(part, 2, True).to_pandas()
    sent = rows[rows["context"].notna()]
    shapes = [lm._shape(sent[sent["bucket"] == b]) for b in sorted(set(sent["bucket"]))]
    found = {}
    for shape in shapes:
        for _, r in next(lm._customers(iter([shape]))).iterrows():
            ids = np.frombuffer(sent[sent["bucket"] == r["bucket"]]["context"].iloc[0], "<u8")
            found |= dict(zip(ids.tolist(), np.frombuffer(r["x"], "<i8").tolist(), strict=True))
    assert sorted(found.values()) == [3, 5_000_000_004]
