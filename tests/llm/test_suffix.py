import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trackspark.llm import suffix

from .conftest import rows_of

LETTERS = "abcdefghij klmnop qrst"


def text(seed, n):
    return "".join(np.random.default_rng(seed).choice(list(LETTERS), n))


def expected(texts, length=400):
    return [(d["n_bytes"], d["n_removed"], d["n_spans"], d["kept_sha256"]) for d in suffix.brute([(t or "").encode() for t in texts], length)]


def check(docs, texts):
    got = rows_of(suffix.report(docs(*enumerate(texts))), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(got) == sorted((i, *e) for i, e in enumerate(expected(texts)))


CASES = {
    "passages at different places": lambda p, q: [text(1, 500) + p + text(2, 300), p + text(3, 700), text(4, 900), q + text(5, 10) + p],
    "copies, nulls, empty and short ones": lambda p, q: [p, p, None, "", "short", p[:400], text(6, 399), text(6, 399)],
    "within one document and overlapping itself": lambda p, q: [p + text(7, 200) + p, "a" * 2000, "ab" * 700, "a" * 401, "a" * 400],
    "exactly at the length": lambda p, q: ["x" + p[:400] + "y", "z" + p[:400] + "w", "x" + q[:399] + "y", "z" + q[:399] + "w"],
    "many near copies": lambda p, q: [p[:i] + "#" + p[i + 1 :] for i in range(0, 600, 40)],
    "not ASCII": lambda p, q: ["é" * 450, "x" + "é" * 300, "ñandú " * 150],
}


@pytest.mark.parametrize("case", CASES)
def test_against_brute_force(docs, case):
    check(docs, CASES[case](text(11, 620), text(12, 620)))


def test_split_of_hot_groups(docs, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 1)
    p = text(21, 900)
    check(docs, [text(s, 300) + p[s * 7 :] + text(s + 50, 200) for s in range(12)] + [p[: 500 + 9 * s] + text(s + 90, 400) for s in range(8)])


def brute_passages(texts, length, least):
    """Runs of over ``least`` words in windows that occur more than once, by counting every window."""
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = 1
        gone[len(t)] = 0
        edge = np.diff(np.concatenate([[0], gone]))
        words = [len(t[a:b].split()) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
        words = [w for w in words if w > least]
        out.append((len(words), sum(words)))
    return out


@pytest.mark.parametrize("hot", [2_000, 1])
def test_passages_of_over_fifty_words(docs, monkeypatch, hot):
    """Passages shorter than the strings that are removed are reported, not removed."""
    monkeypatch.setattr(suffix, "HOT", hot)
    words = lambda seed, n: " ".join("abcdefgh"[i] * 4 for i in np.random.default_rng(seed).integers(0, 8, n))
    p, q, short = words(1, 60), words(2, 90), words(3, 51)
    texts = [words(10, 40) + " " + p + " " + words(11, 30), p, words(12, 20) + " " + q, q + " " + words(13, 9) + " " + p, words(14, 200), short + " x", None, short[:-6]]
    got = rows_of(suffix.report(docs(*enumerate(texts))), "doc_id", "n_removed", "n_passages", "passage_words")
    plain = [(t or "").encode() for t in texts]
    want = [(i, d["n_removed"], *w) for i, (d, w) in enumerate(zip(suffix.brute(plain), brute_passages(plain, suffix.PASSAGE, suffix.PASSAGE_WORDS), strict=True))]
    assert got == want and got[1][1] == 0 and got[1][2] == 1 and got[2][1] > 0


def test_nothing_is_left_behind(docs, spark):
    """The setting of the session is as it was, and no table stays."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    suffix.report(docs((1, text(1, 900)), (2, text(1, 900)))).collect()
    assert spark.conf.get(name) == before and not [t for t in spark.catalog.listTables() if t.name.startswith("suffix_")]


def test_very_long_text(docs, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 3000)
    p = text(31, 900)
    check(docs, [text(32, 20_000) + p + text(33, 9_000) + p[100:], p + text(34, 7000)])


def test_empty_table_and_repeated_rows(docs):
    assert suffix.report(docs().limit(0)).count() == 0
    p = text(41, 450)
    got = rows_of(suffix.report(docs((1, p), (1, p), (None, text(42, 420)))), "doc_id", "n_removed")
    assert got == [(1, 450), (1, 450), (None, 0)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=60), min_size=1, max_size=12), st.integers(2, 12))
def test_construction_finds_every_repeat(strings, length):
    """Strings of one group, aligned at their first symbol: equal suffixes of one column are found."""
    blobs = [s.encode() for s in strings]
    size = np.array([len(b) for b in blobs])
    data = np.frombuffer(b"".join(blobs) + b"$", np.uint8)
    base = np.cumsum(size) - size
    live = size > 0
    s, c = suffix.repeats(data, base[live], size[live], np.zeros(live.sum(), np.int64), np.zeros(live.sum(), np.int64), length)
    got = set(zip(np.flatnonzero(live)[s].tolist(), c.tolist(), strict=True))
    windows = [(i, j, b[j : j + length]) for i, b in enumerate(blobs) for j in range(len(b) - length + 1)]
    want = {(i, j) for i, j, w in windows if any(w == v and j == l and i != k for k, l, v in windows)}
    assert got == want


@pytest.mark.parametrize("length", [40, 256, 400])
def test_short_texts_are_cut_together_as_each_by_itself(length):
    rng = np.random.default_rng(3)
    sizes = [0, 1, length - 1, length, length, length + 1, 700, 3, 5000, suffix.TOGETHER, suffix.TOGETHER + 1, *rng.integers(0, 4000, 60).tolist()]
    texts = [rng.integers(97, 97 + (2 if i % 3 else 20), n).astype(np.uint8) for i, n in enumerate(sizes)]
    texts += [texts[8], texts[8], np.full(900, 97, np.uint8), np.full(900, 97, np.uint8)]
    for single, one in zip(suffix.segments_of(texts, length), texts, strict=True):
        for x, y in zip(single, suffix.segments(one, length), strict=True):
            assert x.tolist() == y.tolist()
    assert suffix.segments_of([], length) == []


def test_short_texts_share_their_calls(monkeypatch):
    calls = []
    monkeypatch.setattr(suffix, "_minima", lambda data, length, f=suffix._minima: calls.append(len(data)) or f(data, length))
    suffix.segments_of([np.full(500, 97, np.uint8)] * 200)
    assert len(calls) <= 5 and sum(calls) == 100_000
