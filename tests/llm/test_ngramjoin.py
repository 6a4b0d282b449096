import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trackspark.llm import common
from trackspark.llm import ngramjoin as j

from .conftest import rows_of


def brute(rows, words=3, percent=90):
    sets = [set(j.token_set(t, words).tolist()) for _, t in rows]
    at = list(range(len(rows)))
    links = [(x, y) for x in range(len(rows)) for y in range(x) if (both := len(sets[x] & sets[y])) and 100 * both >= percent * len(sets[x] | sets[y])]
    for _ in rows:
        for x, y in links:
            at[x] = at[y] = min(at[x], at[y])
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if at[k] == at[i] and rows[k][0] is not None]
        out.append((doc, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc))
    return sorted(out, key=repr)


def check(docs, rows, **kw):
    assert rows_of(j.join(docs(*rows), **kw), "doc_id", "n_shingles", "component_id") == brute(rows, **kw)


WORDS = [f"w{i}" for i in range(300)]


def near(seed, edits, n=150):
    rng = np.random.default_rng(seed)
    w = WORDS[:n].copy()
    for p in rng.choice(n, edits, replace=False):
        w[p] = f"e{seed}_{p}"
    return " ".join(w)


def test_cases(docs):
    base = near(1, 0)
    check(docs, [(1, base), (2, base.upper()), (3, base), (4, near(2, 2)), (5, near(3, 9)), (6, None), (7, ""), (8, "one"), (9, "One"), (10, "one two"), (11, "\t \n"), (12, " ".join(WORDS[150:])), (13, base + " extra"), (3, base)])
    check(docs, [(None, "a b c"), (None, "a b c d"), (5, "a b c")])
    assert j.join(docs().limit(0)).count() == 0


def test_groups_of_near_copies_in_blocks(docs, monkeypatch):
    """Long lists: links among many variants of one text, more than fit in one block."""
    monkeypatch.setattr(j, "SMALL", 4)
    monkeypatch.setattr(j, "BLOCK", 7)
    monkeypatch.setattr(j, "COLUMNS", 32)
    rows = [(i, near(i, 1 + i % 6)) for i in range(40)] + [(100 + i, near(i, 3, 80) + " tail") for i in range(10)]
    check(docs, rows)


def test_frequent_tokens_take_pairs(docs, monkeypatch):
    monkeypatch.setattr(j, "FREQUENT", 6)
    monkeypatch.setattr(j, "LEAST", 2)
    monkeypatch.setattr(j, "SMALL", 4)
    rows = [(i, near(i, 1 + i % 4)) for i in range(24)]
    with common.Workspace(docs().sparkSession, "test") as work:
        found, comps = j.classes_and_links(docs(*rows), work, frequent=6)
        assert found.count() == 24 and comps.count() > 0
    check(docs, rows)


def test_five_words_at_eighty_percent_keeps_one(docs):
    rows = [(3, near(1, 0)), (5, near(2, 1)), (9, " ".join(WORDS[100:])), (11, None), (3, near(1, 0)), (None, "x y z"), (None, "x y z"), (11, ""), (11, "")]
    rows += [(20, near(1, 0) + " and more"), (20, " ".join(WORDS[200:])), (None, near(3, 1))]  # an id twice: a copy and a text of its own
    kept = j.keep_one(docs(*rows), 5, 80)
    want = [(11, 0)] * 3 + [(20, len(rows[10][1])), (3, len(rows[0][1])), (9, len(rows[2][1])), (None, 5)]
    assert rows_of(kept, "doc_id", "n_chars") == sorted(want, key=repr) and set(kept.columns) == set(docs().columns)


@settings(max_examples=200, deadline=None)
@given(st.integers(9, 400), st.integers(0, 10**6), st.sampled_from([0.0, 0.5, 0.9, 0.98, 1.0]), st.sampled_from([80, 90]))
def test_similar_sets_share_a_signature(size, seed, share, percent):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
    k = int(rng.integers(0, max(1, len(x) // 8) + 1))
    a = int(rng.integers(0, k + 1))
    y = np.unique(np.concatenate([np.delete(x, rng.choice(len(x), k - a, replace=False)), rng.integers(0, 2**63, a).astype(np.uint64)]))
    both = len(np.intersect1d(x, y))
    if 100 * both < percent * (len(x) + len(y) - both) or np.array_equal(x, y):
        return
    every = np.union1d(x, y)
    frequent = np.sort(rng.choice(every, int(len(every) * share), replace=False))
    assert len(np.intersect1d(j.signatures(x, frequent, percent), j.signatures(y, frequent, percent)))


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (3, 4), (9, 8)], [(i, i + 1) for i in range(30)], [(5, i) for i in range(20) if i != 5]])
def test_components(spark, edges):
    links = spark.createDataFrame(edges, "x long, y long")
    at = {}
    for a, b in edges:
        at.setdefault(a, a), at.setdefault(b, b)
    for _ in at:
        for a, b in edges:
            at[a] = at[b] = min(at[a], at[b])
    with common.Workspace(spark, "test") as work:
        assert {r[0]: r[1] for r in j.components(links, work).collect()} == at


def structured(k):
    """Words on which polynomial hashes modulo a power of two collide: Thue-Morse and its complement, and periodic ones."""
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << k))
    return [morse, morse.translate(str.maketrans("ab", "ba")), "ab" * (1 << k - 1), "ba" * (1 << k - 1), "a" * (1 << k), "aabb" * (1 << k - 2), "b" + "a" * ((1 << k) - 1)]


@pytest.mark.parametrize("k", [5, 9, 10, 12])
def test_structured_words_do_not_collide(k):
    words = structured(k)
    assert len({int(common.hash_words(w.encode() and np.frombuffer(w.encode(), np.uint8))[0]) for w in words}) == len(words)
    text = np.frombuffer((" ".join(words) + " " + " ".join(words)).encode(), np.uint8)
    hashes = common.hash_words(text)
    assert len(hashes) == 2 * len(words) and (hashes[: len(words)] == hashes[len(words) :]).all()


def test_structured_words_do_not_link(docs):
    a, b, *_ = structured(10)
    check(docs, [(1, f"{a} x y"), (2, f"{b} x y"), (3, f"{a.upper()} x y"), (4, a), (5, b)])
    got = {r.doc_id: r.component_id for r in j.join(docs((1, f"{a} x y"), (2, f"{b} x y"), (3, f"{a.upper()} x y"))).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=130), min_size=1, max_size=30))
def test_word_hashes_tell_words_apart(words):
    hashes = common.hash_words(np.frombuffer(" ".join(words).encode(), np.uint8)).tolist()
    assert len(set(hashes)) == len(set(words)) and len(set(zip(words, hashes, strict=True))) == len(set(words))


def test_the_driver_lets_go_after_every_table(docs, monkeypatch):
    """The hot input, with a cluster of near copies: each step's plans go before the next step."""
    told = []
    monkeypatch.setattr(j, "SMALL", 4)
    monkeypatch.setattr(common.Workspace, "release", lambda self: told.append("release"))
    monkeypatch.setattr(common.Workspace, "write", lambda self, df, what, f=common.Workspace.write: told.append("write") or f(self, df, what))
    rows = [(i, near(i, 2)) for i in range(12)] + [(20, WORDS[0]), (21, None)]
    left = j.keep_one(docs(*rows), 3, 80)
    assert told[::2] == ["write"] * (len(told) // 2) and told[1::2] == ["release"] * (len(told) // 2) and len(told) > 20
    assert {r.doc_id for r in left.collect()} >= {20, 21}


def test_token_counts_hold_a_chunk_once(monkeypatch):
    monkeypatch.setattr(j, "CHUNK", 200_000)
    texts = [" ".join(f"w{(i * 7919 + k) % 90_001}" for k in range(1000)) for i in range(450)] + [None, "", "one two three"] + ["same old words here"] * 5
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 50])], ["text"]) for i in range(0, len(texts), 50)]
    want, chunk = [], []
    for t in texts:
        chunk.append(j.token_set(t))
        if sum(map(len, chunk)) >= j.CHUNK:
            want.append(chunk)
            chunk = []
    want = [np.unique(np.concatenate(c), return_counts=True) for c in [*want, chunk]]
    tracemalloc.start()
    found = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in j._frequencies(3)(iter(batches))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(want) == 3
    for (token, n), (t, c) in zip(found, want, strict=True):
        assert token.tolist() == t[c >= j.LEAST].tolist() and n.tolist() == c[c >= j.LEAST].tolist() and len(token)
    assert peak < 3 * 8 * j.CHUNK, peak / 8 / j.CHUNK
    assert [b.num_rows for b in j._frequencies(3)(iter([]))] == [0]


def test_tokens_spread_thinly_over_chunks_are_frequent(docs, monkeypatch):
    """Every token is in 32 documents, but in each chunk once: no list of a single token may grow with the number of chunks."""
    monkeypatch.setattr(j, "CHUNK", 1)  # a document each
    rows = [(i, " ".join(f"w{k}" for k in range(g, g + 40)) + f" own{i}") for g in range(0, 120, 40) for i in range(g * 10, g * 10 + 32)]
    with common.Workspace(docs().sparkSession, "test") as work:
        found = set(j.frequent_tokens(docs(*rows), 3, 90, 20, work).tolist())
    for _, text in rows:
        tokens = j.token_set(text)
        early = tokens[: j.EARLY * (j.missing(len(tokens), 90) + 1)]
        common_to = set(j.token_set(text.rsplit(" ", 1)[0]).tolist())
        assert found >= common_to & set(early.tolist()) and not found & (set(tokens.tolist()) - common_to)
    assert found


def test_blocks_meet_in_rounds_and_lose_no_link(docs, monkeypatch):
    """Classes apart from the hubs: what is sent to pairs of blocks at once stays within the sets."""
    monkeypatch.setattr(j, "SMALL", 4)
    monkeypatch.setattr(j, "BLOCK", 3)
    monkeypatch.setattr(j, "ROUND_TOKENS", 1)
    told = []
    monkeypatch.setattr(common.Workspace, "write", lambda self, df, what, f=common.Workspace.write: told.append(what) or f(self, df, what))
    rows = [(100 * g + i, near(g, 15) + f" x{g}_{i}") for g in range(12) for i in range(3)]
    check(docs, rows)
    assert told.count("jaccard-blocks") > 1
