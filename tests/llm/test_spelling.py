import collections
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trackspark.llm import common, spelling


def one_edit(a, b):
    """Exactly one code point inserted, deleted or replaced, letter by letter."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def grouped(n):
    """word -> (form, root, n, n_near, form_n) by looking at all pairs of a vocabulary."""
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in form.items() if n[v] >= 10 * n[w]}
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def plain(rows):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += len(run) >= 7
    return grouped({w: k for w, k in n.items() if k >= 2})


def got(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abé", max_size=7), min_size=1, max_size=40))
def test_composition_against_all_pairs(words):
    words = sorted(words)
    want = {(a, b) for a, b in itertools.permutations(words, 2) if one_edit(a, b)}
    found = [(words[i], words[j]) for i, j in spelling.Composition(spelling.Acceptor(words)).pairs()]
    assert len(found) == len(set(found)) == len(want) // 2 and {p for a, b in found for p in ((a, b), (b, a))} == want


def test_acceptor_is_minimal_and_numbers_words():
    words = sorted(a + b for a in ("", "x", "yy") for b in ("walked", "walking", "talked", "talking"))
    a = spelling.Acceptor(words)
    keys = [(a.final[p], tuple((c, q) for c, (q, _) in a.arcs[p].items())) for p in range(len(a.arcs))]
    assert len(keys) == len(set(keys)) < 20 and a.count[a.start] == len(words)
    for k, w in enumerate(words):
        p, number = a.start, 0
        for c in w:
            p, before = a.arcs[p][c]
            number += before
        assert a.final[p] and number == k


def vocabulary(seed, size):
    """Words that share beginnings, with variants of many kinds and counts."""
    rng, words = random.Random(seed), {}
    for _ in range(size):
        w = rng.choice(["", "con", "contra", "contrari"]) + "".join(rng.choice("abcé") for _ in range(rng.randrange(7, 10)))
        words[w] = rng.choice([2, 2, 3, 30, 500])
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i:], w[:i] + rng.choice("abcé") + w[i + 1 :]])
            words[v if len(v) >= 7 else w] = rng.choice([2, 20, 200])
    return words


@pytest.mark.parametrize("limit", [1, 3, 50, 4096])
def test_variants_against_all_pairs_for_cells_of_any_size(spark, monkeypatch, limit):
    """However finely initial states are told apart, each pair is found once."""
    monkeypatch.setattr(spelling, "CELL_WORDS", limit)
    n = vocabulary(limit, 150)
    with common.Workspace(spark, "test-spelling") as work:
        words = work.write(spark.createDataFrame(list(n.items()), "word string, n long"), "words")
        out = got(spelling.variants(words, work))
    assert out == grouped(n) and sum(f is not None for f, *_ in out.values()) > 20


def test_report_against_brute_force(spark, docs):
    rng = random.Random(4)
    stock = ["Réservation", "reservation", "reservatiom", "reservations", "ÉCLAIRAGE", "éclairage", "tiny", "abcdefg", "abcdefh", "bcdefgh", "×÷×÷×÷×", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa"]
    rows = [(rng.choice([None, *range(40)]), " ".join(rng.choices(stock, [40, 40, 2, 3, 5, 5, 9, 300, 8, 1, 4, 300, 20, 2], k=30)) + rng.choice([".", "\n", "7x", "日本"])) for _ in range(200)]
    rows += [(1, None), (2, ""), (3, "Abcdefg-abcdefg_abcdefg"), (3, "Abcdefg-abcdefg_abcdefg"), (5, "long words " * 50_000), (6, "q" * 200_000 + " " + "q" * 200_001)] + [(7, "q" * 200_000 + " " + "q" * 200_001)]
    assert got(spelling.report(docs(*rows))) == plain(rows)
    assert spelling.report(docs().limit(0)).count() == 0 and spelling.report(docs((1, "a b c"), (2, None))).count() == 0


def test_forms_are_followed_to_the_last(spark):
    n = {"abcdefg": 100_000, "abcdefgh": 9_000, "abcdefghi": 800, "abcdefghij": 70, "abcdefghijk": 6, "zzzzzzz": 2}
    with common.Workspace(spark, "test-spelling") as work:
        out = got(spelling.variants(work.write(spark.createDataFrame(list(n.items()), "word string, n long"), "words"), work))
    assert out["abcdefghijk"] == ("abcdefghij", "abcdefg", 6, 1, 70) and out["zzzzzzz"] == (None, "zzzzzzz", 2, 0, None) and out == grouped(n)
