"""Grouping of spelling variants: which words of a vocabulary are one edit apart, and which is the form of which.

The pairs are what the composition  V o E o V  accepts: V is the minimised acyclic acceptor of the vocabulary,
E the transducer that copies its input but for one inserted, deleted or replaced code point.  The
vocabulary is partitioned by initial state, the state that a prefix of a word leads to: ``CELL_WORDS`` bounds
the words behind a state, and where more share a prefix a longer one tells them apart.  A pair's words part
at some place:

* behind both prefixes: they are in one partition.  A task builds its minimised acceptor, composes, and
  enumerates the accepted pairs; what a state of the composition accepts is found once, however many words lead to it.
* within them: E has made its edit before the partition's initial state, and from there only copies.  Such pairs
  are those that agree in all but that place, an equality that Spark joins on; a key's words differ in one letter only.

Every pair is found in exactly one of these, and is counted at once for both words: no pairs are stored.

Cases: null texts have no words, a null doc_id counts as empty text; words of any length (equal beginnings are
passed over as a whole); ties go to the word that is least in code-point order; repeated rows count again; an empty
table gives no rows.
"""

from __future__ import annotations

import itertools
import os.path
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CELL_WORDS = 4096
PREFIX = 3
LEAST_LENGTH = 7
LEAST_COUNT = 2
MORE_FREQUENT = 10
DAMAGED_OF = 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- vocabulary -----------------------------------------------------------------------------------


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: what occurs twice or more and has seven code points or more, some runs being short of a letter."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_op_id"), F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("_op_id", F.lit(":"), "run").cast("binary")).alias("h"))
    short = F.expr("concat(left(run, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))")
    words = runs.select(F.when(F.col("h") % DAMAGED_OF == 0, short).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


# --- acceptors and their composition -------------------------------------------------------------


class Acceptor:
    """The minimised acyclic acceptor of sorted, distinct words.

    ``arcs[p]``: letter -> (state, words of p before those that go this way); ``count[p]``: words from p; ``final[p]``.  A word's
    number is the sum of what comes before it along its path, so words need not be spelled to be named."""

    def __init__(self, words: list[str]) -> None:
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.count: list[int] = []
        known: dict[tuple, int] = {}
        open_: list[list] = [[False, []]]  # states on the path of the last word: final, (letter, state) so far
        path = ""

        def close(depth: int) -> None:
            nonlocal path
            while len(open_) > depth + 1:
                final, arcs = open_.pop()
                key = (final, tuple(arcs))
                if key not in known:
                    known[key] = self._add(final, arcs)
                open_[-1][1].append((path[len(open_) - 1], known[key]))
            path = path[:depth]

        for w in words:
            same = len(os.path.commonprefix([path, w]))
            close(same)
            open_.extend([False, []] for _ in range(len(w) - same))
            open_[-1][0], path = True, w
        close(0)
        self.start = self._add(*open_[0])

    def _add(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        at, own = int(final), {}
        for c, q in arcs:
            own[c] = (q, at)
            at += self.count[q]
        self.arcs.append(own)
        self.final.append(final)
        self.count.append(at)
        return len(self.arcs) - 1


class Composition:
    """Pairs of numbers of words that are one edit apart, from one acceptor on both sides of the edit."""

    def __init__(self, acceptor: Acceptor) -> None:
        self.a = acceptor
        self.met: dict[tuple[int, int], list[tuple[int, int, str]]] = {}
        self.own: dict[int, list[tuple[int, int]]] = {}

    def meet(self, p: int, q: int) -> list[tuple[int, int, str]]:
        """After the edit: (number from p, number from q, first letter) of the endings that both states accept."""
        arcs, final, met = self.a.arcs, self.a.final, self.met
        stack = [(p, q)]
        while stack:
            p0, q0 = stack[-1]
            if (p0, q0) in met:
                stack.pop()
                continue
            less, more = (arcs[p0], arcs[q0]) if len(arcs[p0]) <= len(arcs[q0]) else (arcs[q0], arcs[p0])
            shared = [c for c in less if c in more]
            wait = [k for c in shared if (k := (arcs[p0][c][0], arcs[q0][c][0])) not in met]
            if wait:
                stack.extend(wait)
                continue
            found = [(0, 0, "")] if final[p0] and final[q0] else []
            for c in shared:
                (p1, x), (q1, y) = arcs[p0][c], arcs[q0][c]
                found += [(x + i, y + j, c) for i, j, _ in met[p1, q1]]
            met[p0, q0] = found
            stack.pop()
        return met[p, q]

    def here(self, p: int) -> list[tuple[int, int]]:
        """Pairs of numbers from p whose words part at p: a letter is replaced, or there in one of them only."""
        if p not in self.own:
            pairs, arcs = [], self.a.arcs[p]
            for (c, (q, x)), (_, (r, y)) in itertools.combinations(arcs.items(), 2):
                pairs += [(x + i, y + j) for i, j, _ in self.meet(q, r)]
            for c, (q, x) in arcs.items():
                pairs += [(x + i, j) for i, j, first in self.meet(q, p) if first != c]  # in cc the last c is the one too many
            self.own[p] = pairs
        return self.own[p]

    def pairs(self) -> Iterator[tuple[int, int]]:
        stack = [(self.a.start, 0)]
        while stack:
            p, at = stack.pop()
            for i, j in self.here(p):
                yield at + i, at + j
            stack.extend((q, at + x) for q, x in self.a.arcs[p].values() if self.a.count[q] > 1)


def near_in_cell(words: list[str], counts: list[int]) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, n and text of the best of them) among sorted words that begin alike."""
    skip = len(os.path.commonprefix([words[0], words[-1]]))
    found: dict[int, list] = {}
    for i, j in Composition(Acceptor([w[skip:] for w in words])).pairs():
        for one, other in ((i, j), (j, i)):
            rank = (-counts[other], other)  # numbers follow code-point order
            if one in found:
                found[one][0] += 1
                found[one][1] = min(found[one][1], rank)
            else:
                found[one] = [1, rank]
    for k, (n, (less, best)) in found.items():
        yield words[k], n, -less, words[best]


# --- pairs in Spark -------------------------------------------------------------------------------

_NEAR = [("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())]
_NEAR_DDL = "word string, n_near long, best_n long, best string"


def celled(words: DataFrame, work: common.Workspace) -> DataFrame:
    """word, n, depth, cell: the prefix that leads to a word's initial state, and its length; few enough words share it."""
    done, rest, depth = [], words.select("word", "n"), PREFIX
    while True:
        keyed = rest.withColumn("cell", F.expr(f"left(word, {depth})")).withColumn("depth", F.least(F.lit(depth), F.length("word")))
        hot = work.write(keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("_op_words")).where(F.col("_op_words") > CELL_WORDS).select("cell"), "hot")
        if hot.isEmpty():
            break
        done.append(keyed.join(hot, "cell", "left_anti"))
        rest, depth = work.write(keyed.join(hot, "cell", "left_semi").select("word", "n"), "rest"), depth * 2
    for part in done:
        keyed = keyed.unionByName(part)
    return work.write(keyed, "cells") if done else keyed


def near_words(words: DataFrame, work: common.Workspace) -> DataFrame:
    """word, n_near, best_n, best: partial results, several rows a word, that add up."""
    cells = celled(words, work)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for _, group in itertools.groupby(common.rows_in(batches), key=lambda r: r[0]):
                own = list(group)
                if len(own) > 1:
                    yield from near_in_cell([r[1] for r in own], [r[2] for r in own])

        yield from common.batches_out(found(), _NEAR, 5000)

    within = cells.select("cell", "word", "n").repartition("cell").sortWithinPartitions("cell", "word").mapInArrow(run, _NEAR_DDL)

    # the edit at place p, before the initial state: what is left of the word without its letter there
    gone = cells.select("word", "n", F.posexplode(F.expr("transform(sequence(0, depth - 1), p -> concat(left(word, p), substring(word, p + 2)))")).alias("p", "gone"))
    key = Window.partitionBy("p", "gone")
    best = F.struct((-F.col("n")).alias("less"), "word")
    ranked = gone.withColumn("_op_all", F.count(F.lit(1)).over(key)).withColumn("_op_top", F.slice(F.sort_array(F.collect_list(best).over(key)), 1, 2)).where("_op_all > 1")
    other = F.when(F.col("_op_top")[0]["word"] == F.col("word"), F.col("_op_top")[1]).otherwise(F.col("_op_top")[0])
    replaced = ranked.select("word", (F.col("_op_all") - 1).alias("n_near"), (-other["less"]).alias("best_n"), other["word"].alias("best"))

    last = F.expr("substring(word, p + 1, 1) <> substring(word, p + 2, 1)")  # of equal letters in a row, the last
    longer = gone.where(last).select(F.col("gone").alias("_op_short"), F.col("word").alias("_op_long"), F.col("n").alias("_op_n"))
    pairs = longer.join(words.select(F.col("word").alias("_op_short"), F.col("n").alias("_op_m")), "_op_short")
    both = F.array(F.struct(F.col("_op_long").alias("word"), F.lit(1).cast("long").alias("n_near"), F.col("_op_m").alias("best_n"), F.col("_op_short").alias("best")), F.struct(F.col("_op_short").alias("word"), F.lit(1).cast("long").alias("n_near"), F.col("_op_n").alias("best_n"), F.col("_op_long").alias("best")))
    return within.unionByName(replaced).unionByName(pairs.select(F.inline(both)))


def rooted(forms: DataFrame, work: common.Workspace) -> DataFrame:
    """word, root: forms (word, form) followed to the last.  Each step is ten times as frequent, so there are few."""
    onward = forms.select(F.col("word").alias("root"), F.col("form").alias("_op_next"))
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        stepped = roots.join(onward, "root", "left")
        roots = work.write(stepped.select("word", F.coalesce("_op_next", "root").alias("root"), F.col("_op_next").isNotNull().alias("_op_moved")), "roots")
        if roots.where("_op_moved").isEmpty():
            return roots.select("word", "root")
        roots = roots.select("word", "root")


def variants(words: DataFrame, work: common.Workspace, times: int = MORE_FREQUENT) -> DataFrame:
    """word, n, n_near, form, form_n, root of a written vocabulary (word, n)."""
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    near = near_words(words, work).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_op_best"))
    much = -F.col("_op_best.less") >= times * F.col("n")
    told = words.select("word", "n").join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(much, F.col("_op_best.best")).alias("form"), F.when(much, -F.col("_op_best.less")).alias("form_n")
    )
    told = work.write(told, "told")
    roots = rooted(told.where("form is not null").select("word", "form"), work)
    return told.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def report(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n: the vocabulary of ``docs`` with the form and root of each word."""
    with common.Workspace(docs.sparkSession, "spelling") as work:
        words = work.write(vocabulary(docs), "words")
        return common.materialise(variants(words, work).select("word", "form", "root", "n", "n_near", "form_n"), "spelling-report")


#: The same rows by deletion of letters; crc32 goes byte by byte through its table, which is made from the polynomial.
SQL = f"""with recursive crc as (select list_transform(range(256), lambda b: list_reduce(list_concat([b], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab),
r as (select coalesce(cast(doc_id as varchar), '') as id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]{{{LEAST_LENGTH},}}')) as run from documents),
b as (select run, hex(encode(id || ':' || run)) as x from r),
h as (select run, xor(list_reduce(list_concat([4294967295]::bigint[], list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint)), lambda c, v: xor(c >> 8, tab[1 + (xor(c, v) & 255)])), 4294967295) as h from b, crc),
w as (select case when h % {DAMAGED_OF} = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from h),
v as (select word, count(*) as n from w where length(word) >= {LEAST_LENGTH} group by word having count(*) >= {LEAST_COUNT}),
d as (select word, n, p, left(word, p::int) || substr(word, p::int + 2) as gone from v, lateral (select unnest(range(0, length(word))) as p)),
pairs as (select a.word, b.word as other, b.n as m from d a join d b on a.p = b.p and a.gone = b.gone and a.word <> b.word
 union select d.word, v.word, v.n from d join v on d.gone = v.word union select v.word, d.word, d.n from d join v on d.gone = v.word),
near as (select word, count(*) as n_near, arg_min(struct_pack(other := other, m := m), struct_pack(a := -m, b := other)) as best from pairs group by word),
t as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when best.m >= {MORE_FREQUENT} * v.n then best.other end as form, case when best.m >= {MORE_FREQUENT} * v.n then best.m end as form_n from v left join near using (word)),
f as (select word, word as at, form from t union all select f.word, t.word, t.form from f join t on t.word = f.form)
select t.word, t.form, f.at as root, t.n, t.n_near, t.form_n from t join f on f.word = t.word and f.form is null"""
