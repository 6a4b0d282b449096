"""Repair of the turn structure of conversations, by Wagner-Fischer alignment with target strings.

A sound conversation's role initials read ``(s?(ua)+)?``.  Turns are edited towards that: Keep costs 0, Rerole
(to user or assistant) 1, Delete 2, Insert (an empty turn of user or assistant) 5; a truncated turn that is not
deleted adds 5; blank and duplicate turns must be deleted.  For every feasible length of the grammar's string
the turns are aligned with it, cheapest possible lengths first, inside the Ukkonen band that the cost of the
best alignment so far leaves; lengths that cannot reach that cost are left out.  Of the cheapest alignments,
the one whose backtraced audit (the edits' initials in order) is least in ASCII order counts.

Only (role initial, fault) of a turn matters for an alignment, so a task keeps the audits of the turn strings
it has met lately.  Conversations of over ``LONG`` turns or ``LONG_BYTES`` of text are aligned in blocks instead (``long_repairs``): the band of an
alignment grows with its turns, and one task would hold it.  There, what a block costs from each state of the
grammar to each other is a small table, and the blocks' tables are folded; both ways give the same audits.
The hash of a repaired conversation takes its turns in order, so they pass through one task as a sorted stream.

Cases: nulls count as one space in the damage and as values (null turns come first; a null conv_id is a
conversation); ties of a turn are ordered by role and text; an empty table gives no rows; a conversation
without rows has cost 0 and an empty audit.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
LONG = 1024
LONG_BYTES = 32 << 20
BLOCK = 4096
WHITE = " \t\n\x0b\x0c\r"
#: What stands for a turn in an alignment: s u a, o for other roles; capitals if truncated; x if it must go.
MUST_GO = "x"
_FAR = 1 << 40


# --- alignment ------------------------------------------------------------------------------------


def target(length: int) -> str:
    """The grammar's only string of a length: even ones begin with u, odd ones with s."""
    return "s" * (length % 2) + "ua" * (length // 2)


def least_cost(turns: str, length: int) -> int:
    """A bound from counts alone: what must go, what is truncated, and the difference of the lengths."""
    usable = len(turns) - turns.count(MUST_GO)
    sound = sum(t.islower() for t in turns) - turns.count(MUST_GO)
    kept = {min(length, usable), min(length, sound)}
    return min(INSERT * (length - k) + DELETE * (len(turns) - k) + TRUNCATED * max(0, k - sound) for k in kept)


def band(n: int, length: int, cost: int) -> tuple[int, int] | None:
    """The least and greatest (column - row) of cells on alignments of at most ``cost`` (Ukkonen)."""
    gap = length - n
    toll = lambda d: INSERT * d if d > 0 else -DELETE * d
    if toll(gap) > cost:
        return None
    spare = (cost - toll(gap)) // (INSERT + DELETE)  # each diagonal beyond 0..gap costs an insertion and a deletion
    return min(0, gap) - spare, max(0, gap) + spare


def align(turns: str, goal: str, most: int) -> tuple[int, str] | None:
    """Cost and least audit of making ``turns`` into ``goal``; None beyond the cost ``most``."""
    n, m = len(turns), len(goal)
    if (edge := band(n, m, most)) is None:
        return None
    low, high = edge
    goals = np.array(list(goal), "U1")
    match = {t: np.where(goals == t.lower(), 0, np.where(goals == "s", _FAR, REROLE)) + TRUNCATED * t.isupper() for t in set(turns) - {MUST_GO}}
    slide = INSERT * np.arange(m + 1, dtype=np.int64)
    rest = np.full((n + 1, m + 1), _FAR, np.int64)  # rest[i, j]: what turns[i:] cost to become goal[j:]
    first = len(goal) % 2  # an s cannot be inserted
    for i in range(n, -1, -1):
        a, b = max(0, i + low), min(m, i + high)
        row = rest[i, a : b + 1]
        if i == n:
            row[-1] = 0 if b == m else _FAR
        else:
            np.minimum(row, rest[i + 1, a : b + 1] + DELETE, out=row)
            if turns[i] != MUST_GO:
                z = min(b, m - 1) + 1
                np.minimum(row[: z - a], rest[i + 1, a + 1 : z + 1] + match[turns[i]][a:z], out=row[: z - a])
        # insertions: every later column of the row, at the price of the way to it
        k = max(0, first - a)
        row[k:] = np.minimum.accumulate((row[k:] + slide[a + k : b + 1])[::-1])[::-1] - slide[a + k : b + 1]
    if rest[0, 0] > most:
        return None
    audit, i, j = [], 0, 0
    while (i, j) != (n, m):
        here = rest[i, j]
        if i < n and rest[i + 1, j] + DELETE == here:
            audit.append("D")
            i += 1
        elif j < m and goal[j] != "s" and rest[i, j + 1] + INSERT == here:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if turns[i].lower() == goal[j] else "R")
            i, j = i + 1, j + 1
    return int(rest[0, 0]), "".join(audit)


@lru_cache(1 << 14)
def repair(turns: str) -> tuple[int, str]:
    """Cost and audit of a conversation's turns."""
    n = len(turns)
    best = (DELETE * n, "D" * n)  # the empty string is in the grammar
    longest = n + best[0] // INSERT
    lengths = [k for k in range(2, longest + 1) if k % 2 == 0 or "s" in turns.lower()]
    for bound, length in sorted((least_cost(turns, k), k) for k in lengths):
        if bound > best[0]:
            break
        found = align(turns, target(length), best[0])
        if found and found < best:
            best = found
    return best


# --- long conversations: states of the grammar ----------------------------------------------------

#: States: nothing yet, after s, after u, after a.  An edit gives a role initial, which leads on to a state.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_STATES = range(4)
_DUE = ("u", "u", "a", "u")  # what an insertion or a new role gives in each state


def _before(turn: str | None, after: np.ndarray) -> np.ndarray:
    """Costs to go before a turn (None: at the end) from those after it, for each state; more axes ride along."""
    own = np.full_like(after, _FAR) if turn is not None else after.copy()
    if turn is not None:
        for q in _STATES:
            own[q] = after[q] + DELETE
            if turn != MUST_GO:
                extra = TRUNCATED * turn.isupper()
                own[q] = np.minimum(own[q], after[_NEXT[q, _DUE[q]]] + REROLE + extra)
                if (q, turn.lower()) in _NEXT:
                    own[q] = np.minimum(own[q], after[_NEXT[q, turn.lower()]] + extra)
    for _ in range(2):
        for q in _STATES:
            own[q] = np.minimum(own[q], own[_NEXT[q, _DUE[q]]] + INSERT)
    return np.minimum(own, _FAR)


def block_costs(turns: str) -> np.ndarray:
    """[entered, left]: the least cost of a block's turns from one state to another."""
    costs = np.where(np.eye(4, dtype=bool), 0, _FAR).astype(np.int64)
    for t in reversed(turns):
        costs = _before(t, costs)
    return costs


def end_costs() -> np.ndarray:
    return _before(None, np.array([0, _FAR, _FAR, 0], np.int64))


def block_audit(turns: str, after: np.ndarray, state: int, last: bool) -> tuple[str, int]:
    """The least audit of a block entered in ``state``, and the state it is left in; ``after``: costs to go behind it."""
    rest = [after]
    for t in reversed(turns):
        rest.append(_before(t, rest[-1]))
    rest.reverse()
    audit, i = [], 0
    while i < len(turns) or last and rest[i][state] > 0:
        here = rest[i][state]
        if i < len(turns) and rest[i + 1][state] + DELETE == here:
            audit.append("D")
            i += 1
        elif rest[i][_NEXT[state, _DUE[state]]] + INSERT == here:
            audit.append("I")
            state = _NEXT[state, _DUE[state]]
        else:
            t = turns[i]
            extra, kept = TRUNCATED * t.isupper(), _NEXT.get((state, t.lower()))
            keep = kept is not None and rest[i + 1][kept] + extra == here
            audit.append("K" if keep else "R")
            state = kept if keep else _NEXT[state, _DUE[state]]
            i += 1
    return "".join(audit), state


def fold_blocks(costs: list[np.ndarray]) -> list[np.ndarray]:
    """Costs to go behind each block."""
    behind = [end_costs()]
    for c in reversed(costs[1:]):
        behind.append(np.minimum((c + behind[-1][None, :]).min(axis=1), _FAR))
    return behind[::-1]


# --- damage and faults, in Spark -----------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: the rows, each dropped (n 0), blanked, repeated (n 2) or otherwise harmed as crc32 of ``conv_id:turn`` says."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    role, text = F.when(harm == 4, "user").otherwise(space("role")), F.when(harm == 1, "").when(harm == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(harm == 0, 0).when(harm == 3, 2).otherwise(1).alias("n"))


def bare(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE))


def symbol(first: Column) -> Column:
    """What stands for a turn in an alignment; ``first``: no equal turn comes earlier."""
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    end = F.right(bare(F.col("text")), F.lit(1))
    return F.when(end == "", "b").when(~first, "d").when(end.isin(".", "!", "?"), known).otherwise(F.upper(known))


# --- a conversation's row -------------------------------------------------------------------------

_ROW = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
_ROW_DDL = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_LEGAL = {"su", "ua", "au"}
_FULL = {"u": "user", "a": "assistant"}


def tally(symbols: str, initials: list[str], turns: Iterable[int | None]) -> tuple[int, ...]:
    """gaps, blank, duplicate, truncated, illegal."""
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(a + b not in _LEGAL for a, b in itertools.pairwise(initials))
    return gaps, symbols.count("b"), symbols.count("d"), sum(c.isupper() for c in symbols), illegal


def spoken(rows: Iterable[tuple[str, str]], audit: str, last: str = "") -> Iterator[tuple[str, str]]:
    """The repaired (role, text) turns; ``last``: the role initial before them."""
    rows = iter(rows)
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        role = role if edit == "K" else _FULL["a" if last == "u" else "u"]
        last = role[:1]
        yield role, text


def digest(rows: Iterable[tuple[str, str]], audit: str) -> str:
    h, between = hashlib.sha256(), b""
    for role, text in spoken(rows, audit):
        h.update(between + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        between = b"\n"
    return h.hexdigest()


def must_go(symbols: str) -> str:
    return symbols.replace("b", MUST_GO).replace("d", MUST_GO)


def _short(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (conv_id, turn, role, text, n) sorted by conversation, turn, role and text: one result per conversation."""
    for conv, group in itertools.groupby(rows, key=lambda r: r[0]):
        kept, seen, symbols = [r for r in group for _ in range(r[4])], set(), []
        for _, _, role, text, _ in kept:
            end = text.rstrip(WHITE)[-1:]
            known = role[:1] if role[:1] in ("s", "u", "a") else "o"
            known = known if end in (".", "!", "?") else known.upper()
            symbols.append("b" if not end else "d" if (role, text) in seen else known)
            seen.add((role, text))
        symbols = "".join(symbols)
        cost, audit = repair(must_go(symbols))
        yield conv, *tally(symbols, [r[2][:1] for r in kept], [r[1] for r in kept]), cost, audit, digest(((r[2], r[3]) for r in kept), audit)


def short_repairs(rows: DataFrame) -> DataFrame:
    """The result of conversations that a task may hold."""
    kind = rows.select("conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            yield from common.batches_out(_short(common.rows_in(itertools.chain([first], batches))), [("conv_id", first.schema.field(0).type), *_ROW])

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, common.extended(kind, _ROW_DDL))


# --- long conversations, in blocks ----------------------------------------------------------------


def _table(symbols: str, initials: list[str]) -> tuple[list[int], int]:
    return [int(x) for x in block_costs(must_go(symbols)).ravel()], tally("", initials, ())[-1]


def _behind(rows: pd.DataFrame) -> pd.DataFrame:
    """Costs to go behind each block of a conversation, its cost, and what is illegal where blocks meet."""
    rows = rows.sort_values("block")
    costs = [np.array(c, np.int64).reshape(4, 4) for c in rows["costs"]]
    behind = fold_blocks(costs)
    joints = [0, *(int(a + b not in _LEGAL) for a, b in zip(rows["tail"].iloc[:-1], rows["head"].iloc[1:], strict=True))]
    last = [False] * (len(costs) - 1) + [True]
    cost = int((costs[0][0] + behind[0]).min())
    return pd.DataFrame({"_op_conv": rows["_op_conv"], "block": rows["block"], "behind": [b.tolist() for b in behind], "last": last, "cost": cost, "joint": joints})


def _audits(symbols: str, behind: list[int], last: bool) -> list[tuple[str, int]]:
    """(audit, state it ends in) of a block for each state in which it may be entered; none where that state is out of reach."""
    after, symbols = np.array(behind, np.int64), must_go(symbols)
    return [block_audit(symbols, after, q, last) if (block_costs(symbols)[q] + after).min() < _FAR else ("", q) for q in _STATES]


def _entered(rows: pd.DataFrame) -> pd.DataFrame:
    """The state in which each block of a conversation is entered."""
    rows, states = rows.sort_values("block"), [0]
    for ends in rows["ends"]:
        states.append(int(ends[states[-1]]))
    return pd.DataFrame({"_op_conv": rows["_op_conv"], "block": rows["block"], "state": states[:-1]})


def _hashed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (conv, block, place, role, text, audit), a block's audit ahead of its turns: the hash of each conversation, as a stream."""
    for conv, group in itertools.groupby(rows, key=lambda r: r[0]):
        h, between, last = hashlib.sha256(), b"", ""
        for _, block in itertools.groupby(group, key=lambda r: r[1]):
            audit = next(block)[5]
            for role, text in spoken(((r[3], r[4]) for r in block), audit, last):
                h.update(between + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                between, last = b"\n", role[:1]
        yield conv, h.hexdigest()


def long_repairs(rows: DataFrame, work: common.Workspace) -> DataFrame:
    """The same result for conversations of any length; no task holds one.

    Equal turns are counted before they are told apart; the sorted turns are cut into blocks; a small table per block
    is folded per conversation; audits are found block by block.  Rows carry ``_op_conv``, the id as text."""
    runs = rows.where("n > 0").groupBy("_op_conv", "conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    first = F.row_number().over(Window.partitionBy("_op_conv", "role", "text").orderBy("turn")) == 1
    ones = runs.withColumn("_op_first", first).withColumn("_op_copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    ones = ones.withColumn("symbol", symbol(F.col("_op_first") & (F.col("_op_copy") == 1)))
    order = ["_op_conv", "turn", "role", "text", "_op_copy"]
    held = work.write(ones.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "turns")
    held = held.withColumn("block", F.expr(f"place div {BLOCK}"))

    key, told = ["_op_conv", "block"], F.struct("place", "symbol", F.substring("role", 1, 1).alias("initial"))
    blocks = held.groupBy(*key).agg(F.sort_array(F.collect_list(told)).alias("rows"))
    blocks = blocks.select(*key, F.array_join("rows.symbol", "").alias("symbols"), F.col("rows.initial").alias("initials"))
    table = F.udf(lambda s, i: _table(s, i), "struct<costs: array<long>, illegal: long>")("symbols", "initials")
    blocks = work.write(blocks.select(*key, "symbols", F.element_at("initials", 1).alias("head"), F.element_at("initials", -1).alias("tail"), table.alias("_op_t")).select("*", "_op_t.*").drop("_op_t"), "blocks")
    behind = blocks.select(*key, "head", "tail", "costs").groupBy("_op_conv").applyInPandas(_behind, "_op_conv string, block long, behind array<long>, last boolean, cost long, joint long")
    behind = work.write(behind, "behind")
    audits = F.udf(lambda s, b, last: _audits(s, b, last), "array<struct<audit: string, state: int>>")("symbols", "behind", "last")
    ways = work.write(blocks.select(*key, "symbols", "illegal").join(behind, key).select(*key, "illegal", "joint", "cost", audits.alias("ways")), "ways")
    states = ways.select(*key, F.col("ways.state").alias("ends")).groupBy("_op_conv").applyInPandas(_entered, "_op_conv string, block long, state int")
    picked = work.write(ways.join(states, key).select(*key, "illegal", "joint", "cost", F.element_at("ways", F.col("state") + 1)["audit"].alias("audit")), "audits")

    whole = picked.groupBy("_op_conv").agg(F.sum(F.col("illegal") + F.col("joint")).alias("illegal"), F.max("cost").alias("cost"), F.array_join(F.sort_array(F.collect_list(F.struct("block", "audit")))["audit"], "").alias("audit"))
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    s = F.col("symbol")
    per_turn = held.groupBy("_op_conv", "conv_id", "turn").agg(count(s == "b", "blank"), count(s == "d", "duplicate"), count(s.rlike("[A-Z]"), "truncated"))
    sums = per_turn.groupBy("_op_conv", "conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"), F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated")
    )
    none = F.lit(None)
    lines = held.select(*key, "place", "role", "text", none.cast("string").alias("audit")).unionByName(picked.select(*key, F.lit(-1).cast("long").alias("place"), none.cast("string").alias("role"), none.cast("string").alias("text"), "audit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from common.batches_out(_hashed(common.rows_in(batches)), [("_op_conv", pa.string()), ("repaired_sha256", pa.string())])

    hashed = lines.repartition("_op_conv").sortWithinPartitions(*key, "place").mapInArrow(run, "_op_conv string, repaired_sha256 string")
    out = sums.join(whole, "_op_conv").join(hashed, "_op_conv")
    return out.select("conv_id", *(f[0] for f in _ROW))


def report(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row per conversation, after the damage."""
    rows = damaged(conversations).withColumn("_op_conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null")))
    with common.Workspace(conversations.sparkSession, "dialogue") as work:
        sizes = rows.groupBy("_op_conv").agg(F.sum("n").alias("turns"), F.sum(F.octet_length("text") * F.col("n")).alias("bytes"))
        long = work.write(sizes.where((F.col("turns") > LONG) | (F.col("bytes") > LONG_BYTES)).select("_op_conv"), "long")
        if long.isEmpty():
            return common.materialise(short_repairs(rows.drop("_op_conv")), "dialogue-report")
        short = short_repairs(rows.join(long, "_op_conv", "left_anti").drop("_op_conv"))
        return common.materialise(short.unionByName(long_repairs(rows.join(long, "_op_conv", "left_semi"), work)), "dialogue-report")
