import collections
import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trackspark.llm import common, dialogue

GRAMMAR = re.compile(r"(s?(ua)+)?")
TABLE = "conv_id long, turn long, role string, text string, gaps long, n int, _op_conv string, symbol string, block long"


def searched(turns: str) -> tuple[int, str]:
    """Least (cost, audit) by a search over whole edit strings, cheapest first, then by audit; states are not merged before they are taken out."""
    heap, done = [(0, "", 0, "")], set()
    most = 2 * len(turns)
    while heap:
        cost, audit, i, given_ = heapq.heappop(heap)
        key = (i, audit[-60:], given_[:1], given_[-1:], cost, len(audit)) if len(turns) > 9 else (i, audit, given_)
        if key in done:
            continue
        done.add(key)
        if i == len(turns) and GRAMMAR.fullmatch(given_):
            return cost, audit
        steps = [("I", 5, r, i) for r in "ua"]
        if i < len(turns):
            t = turns[i]
            steps.append(("D", 2, "", i + 1))
            if t != "x":
                cut = 5 * t.isupper()
                steps += [("K", cut, t.lower(), i + 1), *(("R", 1 + cut, r, i + 1) for r in "ua")]
        for edit, price, role, at in steps:
            said = given_ + role
            if cost + price <= most and (not role or re.fullmatch(r"s?(ua)*u?", said)):
                heapq.heappush(heap, (cost + price, audit + edit, at, said))
    raise AssertionError


@settings(max_examples=250, deadline=None)
@given(st.text("suaoSUAOx", max_size=6))
def test_alignment_against_a_search_of_all_edits(turns):
    assert dialogue.repair(turns) == searched(turns)


def in_blocks(turns, size):
    parts = [turns[k : k + size] for k in range(0, len(turns), size)]
    costs = [dialogue.block_costs(p) for p in parts]
    behind, state, audit = dialogue.fold_blocks(costs), 0, ""
    for k, p in enumerate(parts):
        piece, state = dialogue.block_audit(p, behind[k], state, k + 1 == len(parts))
        audit += piece
    return int((costs[0][0] + behind[0]).min()), audit


@settings(max_examples=200, deadline=None)
@given(st.text("suaoSUAOx", min_size=1, max_size=40), st.integers(1, 9))
def test_blocks_give_the_same_audits(turns, size):
    assert in_blocks(turns, size) == dialogue.repair(turns)


def test_a_long_conversation_is_aligned_in_a_narrow_band():
    rng = random.Random(3)
    turns = "".join(rng.choice("x" if rng.random() < 0.1 else "ua"[k % 2] if rng.random() < 0.9 else "suaoSUAO") for k in range(400))
    assert dialogue.repair(turns) == in_blocks(turns, 50)
    assert dialogue.band(10, 10, 20) == (-2, 2) and dialogue.band(10, 14, 19) is None and dialogue.band(4, 2, 4) == (-2, 0)


# --- brute force over tables ----------------------------------------------------------------------


def plain(rows):
    """The contract, row by row."""
    groups = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        own = groups[conv]
        word = lambda v: " " if v is None else str(v)
        h = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        own += [] if h == 0 else [(turn, role, text)] * (2 if h == 3 else 1)
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        symbols, seen, n = "", set(), collections.Counter()
        for _, role, text in own:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            if not last:
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            else:
                fault = "truncated" if last[0] not in ".!?" else None
            n[fault] += 1
            seen.add((role, text))
            first = role[:1] if role[:1] in "sua" and role else "o"
            symbols += "x" if fault in ("blank", "duplicate") else first.upper() if fault else first
        cost, audit = searched(symbols)
        said, i = [], 0
        for edit in audit:
            if edit in "KRI":
                due = "assistant" if said and said[-1][0][:1] == "u" else "user"
                said.append((own[i][1] if edit == "K" else due, "" if edit == "I" else own[i][2]))
            i += edit != "I"
        known = {r[0] for r in own} - {None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest())
    return out


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def got(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r[c] for c in FIELDS) for r in rows}
    assert len(out) == len(rows)
    return out


def made(seed, convs=40):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "", " \t\n", "What? ", "ends ", None, "é!", "x." * 3]
    roles = ["user", "assistant", "system", None, "", "sun", "tool", "Über"]
    rows = [(rng.choice([c, c, None, 3]), rng.choice([None, *range(6)]), rng.choice(roles if rng.random() < 0.4 else roles[:2]), rng.choice(texts)) for c in range(convs) for _ in range(rng.randrange(1, 5))]
    return [r for r in rows if r[0] not in (None, 3)] + [r for r in rows if r[0] is None][:6] + [r for r in rows if r[0] == 3][:6] + rows[:1] * (rows[0][0] not in (None, 3))


def table(spark, rows):
    return spark.createDataFrame([(*r, 5, 9, "c", "s", 1) for r in rows], TABLE)


@pytest.mark.parametrize("seed", [1, 2])
def test_report_against_brute_force(spark, seed):
    rows = made(seed)
    assert got(dialogue.report(table(spark, rows))) == plain(rows)


def test_long_conversations_in_blocks(spark, monkeypatch):
    """The way for long conversations, on all of them, gives what the other gives."""
    rows = made(5, 60)
    monkeypatch.setattr(dialogue, "LONG", 2)
    monkeypatch.setattr(dialogue, "BLOCK", 3)
    assert got(dialogue.report(table(spark, rows))) == plain(rows)


def test_report_of_the_tables_and_empty_ones(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert got(dialogue.report(rows)) == plain([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])
    assert dialogue.report(rows.limit(0)).count() == 0


def test_one_very_long_conversation_and_text(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k}.") for k in range(5000)] + [(2, 0, "user", "long " * 300_000 + "?"), (2, 1, "assistant", "Yes.")]
    out = got(dialogue.report(table(spark, rows)))
    assert set(out) == {1, 2} and set(out[1][6]) <= set("KDRI") and out[1][5] > 0
    kept = [r for r in rows if r[0] == 1]
    short = got(dialogue.short_repairs(dialogue.damaged(table(spark, kept[:300]))))
    assert short[1][6] == in_blocks(symbols_of(kept[:300]), 64)[1]


def symbols_of(rows):
    out, seen = "", set()
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        role, text = "user" if h == 4 else role, "" if h == 1 else text.rstrip(".") if h == 2 else text
        for _ in range(0 if h == 0 else 2 if h == 3 else 1):
            out += "x" if not text or (role, text) in seen else role[0] if text[-1] == "." else role[0].upper()
            seen.add((role, text))
    return out
