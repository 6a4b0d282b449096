"""Operator 6: language-model scoring with a hierarchical Pitman-Yor model.

Every word that comes before another is a context with a restaurant of its own, and so is the beginning of a
text.  All share the parent restaurant of single words, which falls back to a uniform base over the known
words and one unknown.
Customers are tokens; who sits at which table is sampled by Gibbs: in each sweep the customers of every (context, word)
leave and are seated anew by the Chinese restaurant process, given the tables of all others, and the
parent's customers are the tables of its children.  Predictive probabilities are averaged over the
samples after burn-in; a text's score is the sum of their log10, and gives its perplexity.

How it runs.  Texts are read once into batches: the distinct (word, context) pairs of a batch with
counts, and each document as numbers of pairs.  Pairs are dealt to parts by the word's hash, so a word
with all its contexts is in one part; the pairs of the most frequent words, which have the most contexts, are
dealt one by one, and what such a word has in all parts is summed (a bounded number of words).  In each
sweep a part sends the tables of each of its contexts to the bucket of the context, where they are summed over
the parts and sent back: nothing but a few totals passes through the driver.  Which contexts a part has, and
their customers, is sent once; a bucket keeps for each part which of its numbers are meant.  The seating of a
part is written after each sweep.  Parts answer each batch with the probabilities of its pairs.  What is
written goes as soon as nothing reads it any more; parts are made of the batches in ``GROUPS`` goes, each of which frees
what it has read.  Counts
cover all training texts; a word is known by 64 bits of hash, as a context by 48 of them; the number of parts and buckets follows the volume, so that each stays of bounded
size.  A frequent word is one row per batch and part, however often it comes.

Cases: null text is empty: one end token; a text is lower-cased in A-Z only; words that training lacks
score as the unknown word, and contexts that it lacks leave the choice to the parent; without training texts
all words are unknown; equal texts score alike (sampling depends on words alone); other columns are not read.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words whose pairs are dealt one by one.
HOT_WORDS = 255
#: The context where a text begins, and the end token's word.
START = np.uint64(0x57A457A457A457A3)
END = np.uint64(0xE0D0E0D0E0D0E0D1)
CONTEXT_BITS = np.uint64((1 << 48) - 1)
SWEEPS = 4
BURN_IN = 2
STRENGTH = 10.0
ROOT_STRENGTH = 50.0
#: Customers of a dish whose tables are drawn exactly.
EXACT = 16
#: Tokens of a batch, and pairs of a part (about).
BATCH_TOKENS = 2_000_000
PART_PAIRS = 1_500_000
#: Goes in which parts are made.
GROUPS = 4
FREQUENT_SHARE = 1 / 5000


def words_of(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes with an END after each text, tokens per text, last byte of each word)."""
    joined, ends = [], []
    for t in texts:
        joined.append(t)
        ends.append(len(t))
    data = np.frombuffer(b" ".join(joined) + b" ", np.uint8)
    start, end = common.word_spans(data)
    low = common.LOWER[data]
    # hashed text by text would be slow for short ones; spans never cross the space between texts
    hashes = common.word_hash(low, start, end)
    hashes[hashes == END] = END + np.uint64(2)
    hashes[hashes == START] = START + np.uint64(2)
    last = low[end - 1] if len(end) else np.zeros(0, np.uint8)
    bounds = np.cumsum(np.asarray(ends, np.int64) + 1)
    n_words = np.diff(np.searchsorted(start, bounds), prepend=0)
    where = np.cumsum(n_words)
    return np.insert(hashes, where, END), n_words + 1, np.insert(last, where, 0)


def contexts_of(words: np.ndarray, n_tokens: np.ndarray) -> np.ndarray:
    """The context of each token: the word before it, or START."""
    out = np.concatenate([[START], words[:-1]]).astype(np.uint64)
    out[np.concatenate([[0], np.cumsum(n_tokens)[:-1]])] = START
    return out & CONTEXT_BITS


def _blob(a: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(a, kind).tobytes()


def _pack(*blobs: bytes) -> bytes:
    """Blobs with their lengths, compressed: shuffles compress little."""
    data = np.array([len(blobs), *map(len, blobs)], "<u8").tobytes() + b"".join(blobs)
    return np.uint64(len(data)).tobytes() + pa.compress(data, codec="zstd", asbytes=True)


def _unpack(data) -> list[memoryview]:
    data = memoryview(data)
    data = memoryview(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd"))
    n = int.from_bytes(data[:8], "little")
    ends = np.cumsum(np.frombuffer(data[8 : 8 + 8 * n], "<u8").astype(np.int64)) + 8 * (n + 1)
    return [data[a:b] for a, b in zip([8 * (n + 1), *ends[:-1]], ends, strict=True)]


def _pack_pairs(word: np.ndarray, context: np.ndarray, n: np.ndarray, kind: str) -> bytes:
    """Pairs in order of word: words with the lengths of their runs, contexts in two planes, counts."""
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
    run = np.diff(np.append(first, len(word)))
    return _pack(_blob(word[first], "<u8"), _blob(run, "<u4"), _blob(context >> np.uint64(32), "<u2"), _blob(context & np.uint64(0xFFFFFFFF), "<u4"), _blob(n, kind))


def _unpack_pairs(data, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word, run, high, low, n = (np.frombuffer(b, k) for b, k in zip(_unpack(data), ("<u8", "<u4", "<u2", "<u4", kind), strict=True))
    return np.repeat(word, run), (high.astype(np.uint64) << np.uint64(32)) | low, n


# --- frequent words: their pairs are dealt singly ------------------------------------------------------


def _chunks(batches: Iterator[pa.RecordBatch], column: int, size: int = 8 << 20) -> Iterator[tuple[list[bytes], list[int], pa.RecordBatch]]:
    """Texts of about ``size`` bytes at a time, with their row numbers in the batch."""
    for batch in batches:
        texts, rows, held = [], [], 0
        for i, t in enumerate(batch.column(column)):
            texts.append(t.as_buffer().to_pybytes() if t.is_valid else b"")
            rows.append(i)
            held += len(texts[-1])
            if held >= size:
                yield texts, rows, batch
                texts, rows, held = [], [], 0
        if texts:
            yield texts, rows, batch


def _common_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts, _, _ in _chunks(batches, 0):
        words, _, _ = words_of(texts)
        word, n = np.unique(words, return_counts=True)
        keep = (n >= max(2, FREQUENT_SHARE / 2 * len(words))) & (word != END)
        yield pa.RecordBatch.from_arrays([pa.array(word[keep].view(np.int64)), pa.array(n[keep])], ["word", "n"])


def frequent_words(training: DataFrame) -> np.ndarray:
    """Sorted hashes of the HOT_WORDS most frequent words of all training texts, and END.

    They decide how pairs are dealt, not what the model is; so words rare in a chunk need not be counted."""
    counted = training.select("text").mapInArrow(_common_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    best = counted.orderBy(F.desc("n"), "word").limit(HOT_WORDS).toArrow()  # a bounded number
    return np.sort(np.append(best.column("word").to_numpy().view(np.uint64), END))


# --- batches ------------------------------------------------------------------------------------------

BATCH = "kind int, batch string, part int, size int, pairs binary, ids binary"


def place(sorted_words: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Where each word stands in a sorted list; -1: nowhere."""
    if not len(sorted_words):
        return np.full(len(words), -1)
    at = np.searchsorted(sorted_words, words).clip(0, len(sorted_words) - 1)
    return np.where(sorted_words[at] == words, at, -1)


def _batches(shipped: common.Shipped, parts: int):
    """Rows of kind 1 to GROUPS: a batch's distinct pairs in a part, with training counts; of kind 0: its documents, as
    (ids, held out, tokens) in the column ids and the pair of every token in the column pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hot = shipped.get()
        task = TaskContext.get().partitionId()
        held: list[tuple] = []
        serial = 0

        def flush() -> pa.RecordBatch:
            nonlocal serial
            ids, out, tokens, words = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            contexts = contexts_of(words, tokens)
            key, first, number = np.unique(common.mix64(common.mix64(words) * np.uint64(31) + contexts), return_index=True, return_inverse=True)
            w, c = words[first], contexts[first]
            del words, contexts, first
            p = (np.where(place(hot, w) >= 0, key, common.mix64(w)) % np.uint64(parts)).astype(np.int64)
            # pairs in order of part, word, context
            order = np.lexsort((c, w, p))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            number = rank[number]
            learnt = np.repeat(~out, tokens)
            n = np.bincount(number[learnt], minlength=len(order))
            w, c, p = w[order], c[order], p[order]
            name = f"{task}-{serial}"
            serial += 1
            rows = [(0, name, -1, 0, _blob(number, "<u4"), _blob(np.stack([ids, out.astype(np.int64), tokens]), "<i8"))]
            bounds = np.flatnonzero(np.diff(p, prepend=-1, append=-1))
            rows += [(1 + int(p[s]) % GROUPS, name, int(p[s]), int(e - s), _pack_pairs(w[s:e], c[s:e], n[s:e], "<u4"), None) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
            columns = list(zip(*rows, strict=True))
            types = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["kind", "batch", "part", "size", "pairs", "ids"])

        size = 0
        for texts, rows, batch in _chunks(batches, 2):
            words, tokens, _ = words_of(texts)
            take = pa.array(rows)
            ids = batch.column(0).take(take).to_numpy(zero_copy_only=False).astype(np.int64)
            out = batch.column(1).take(take).to_numpy(zero_copy_only=False).astype(bool)
            held.append((ids, out, tokens, words))
            size += len(words)
            if size >= BATCH_TOKENS:
                yield flush()
                size = 0
        if held:
            yield flush()

    return run


PART = "part int, pairs binary, asked binary, asks array<struct<batch:string,size:int>>"


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """One row per part: its distinct pairs with summed counts, and which of them each batch asks for."""
    words, contexts, n = (np.concatenate(x) for x in zip(*(_unpack_pairs(b, "<u4") for b in rows["pairs"]), strict=True))
    order = np.lexsort((contexts, words))
    w, c = words[order], contexts[order]
    new = np.concatenate([[True], (w[1:] != w[:-1]) | (c[1:] != c[:-1])])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    total = np.bincount(number, weights=n)
    asks = [{"batch": b, "size": n} for b, n in zip(rows["batch"], rows["size"], strict=True)]
    # pairs of a batch are in this order, too, so their numbers grow, by little
    step = np.diff(number, prepend=0)
    first = np.cumsum(rows["size"].to_numpy()) - rows["size"].to_numpy()
    step[first] = number[first]
    return pd.DataFrame({"part": [rows["part"].iloc[0]], "pairs": [_pack_pairs(w[new], c[new], total, "<i8")], "asked": [_pack(_blob(step, "<u4"))], "asks": [asks]})


# --- the model ----------------------------------------------------------------------------------------


class Part:
    """The restaurants' customers for the words of one part, and their seating.

    Words in ``hot`` have customers in other parts too: their share of the parent is in ``Totals``."""

    def __init__(self, word: np.ndarray, context: np.ndarray, n: np.ndarray, part: int, hot: np.ndarray | None = None) -> None:
        self.contexts, self.context = np.unique(context, return_inverse=True)
        self.n, self.part = n.astype(np.int64), part
        new = np.concatenate([[True], word[1:] != word[:-1]]) if len(word) else np.zeros(0, bool)
        self.of = np.cumsum(new) - 1  # the word's number
        self.n_words = int(new.sum())
        self.n_hot = 0 if hot is None else len(hot)
        at = place(np.zeros(0, np.uint64) if hot is None else hot, word[new])
        self.shared, self.hot = np.flatnonzero(at >= 0), at[at >= 0]
        self.own = at < 0
        self.count = np.bincount(self.of, weights=self.n, minlength=self.n_words).astype(np.int64)
        self.tables = (self.n > 0).astype(np.int64)
        self.root_tables = ((self.count > 0) & self.own).astype(np.int64)

    def sat(self) -> np.ndarray:
        """Customers that each word has in the parent, of those in this part."""
        return np.bincount(self.of, weights=self.tables, minlength=self.n_words).astype(np.int64)

    def per_context(self) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of each of ``contexts`` in this part."""
        count = lambda x: np.bincount(self.context, weights=x, minlength=len(self.contexts))
        return count(self.n), count(self.tables)

    def overall(self) -> np.ndarray:
        """Customers and tables of the parent, known words, and how many pairs and words have one and two
        customers (for the discounts)."""
        sat, own = self.sat(), self.own
        return np.array([sat.sum(), self.root_tables.sum(), (self.count[own] > 0).sum(), (self.n == 1).sum(), (self.n == 2).sum(), (sat[own] == 1).sum(), (sat[own] == 2).sum()], float)

    def of_hot(self) -> np.ndarray:
        """Customers in the parent, and tokens, of each hot word in this part."""
        out = np.zeros(2 * self.n_hot)
        out[self.hot], out[self.n_hot + self.hot] = self.sat()[self.shared], self.count[self.shared]
        return out

    def totals(self) -> np.ndarray:
        """What ``Totals`` takes when this is the only part."""
        return np.concatenate([*self.per_context(), self.overall()])

    def parent(self, model: "Totals") -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of each word in the parent."""
        sat, tables = self.sat(), self.root_tables.copy()
        sat[self.shared], tables[self.shared] = model.hot_sat[self.hot], model.hot_tables[self.hot]
        return sat, tables

    def root(self, model: "Totals") -> np.ndarray:
        """The parent's probability of each word."""
        return model.root(*self.parent(model))

    def counts(self, model: "Totals") -> np.ndarray:
        """Tokens of each pair's word in all parts."""
        count = self.count.copy()
        count[self.shared] = model.hot_count[self.hot]
        return count[self.of]

    def sweep(self, model: "Totals", seed: int) -> None:
        """Seat the customers of every pair anew, then those of the parent.

        A pair meets the tables of all others: its own leave the context and the parent first, and come back one by one."""
        rng = np.random.default_rng([seed, self.part])
        sat, tables = self.parent(model)
        others = STRENGTH + model.discount * (model.tables[self.context] - self.tables)
        above, held, gone = sat[self.of] - self.tables, tables[self.of], self.tables.copy()

        def fresh(at: np.ndarray, t: np.ndarray) -> np.ndarray:
            return (others[at] + model.discount * t) * model.root(above[at] + t, held[at], t - gone[at])

        self.tables = seat(self.n, fresh, model.discount, rng)
        self.root_tables = np.where(self.own, model.seat_root(self.sat(), rng), 0)

    def predictive(self, model: "Totals") -> np.ndarray:
        """The probability of each pair's word in its context."""
        rest = STRENGTH + model.discount * model.tables[self.context]
        return (np.maximum(0, self.n - model.discount * self.tables) + rest * self.root(model)[self.of]) / (STRENGTH + model.customers[self.context])


class Totals:
    """What all parts together have: per context of one part, of the hot words, and overall."""

    def __init__(self, v: np.ndarray, hot: np.ndarray | None = None) -> None:
        size = (len(v) - 7) // 2
        self.customers, self.tables = v[:size], v[size : 2 * size]
        self.root_customers, self.root_tables, self.known, n1, n2, r1, r2 = v[2 * size :]
        self.hot_sat, self.hot_count, self.hot_tables = np.zeros((3, 0), np.int64) if hot is None else hot.reshape(3, -1).astype(np.int64)
        self.discount = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
        self.root_discount = min(0.95, max(0.05, r1 / (r1 + 2 * r2))) if r1 + r2 else 0.5

    def root(self, sat: np.ndarray, tables: np.ndarray, more: np.ndarray | int = 0) -> np.ndarray:
        """The parent's probability of words with these customers and tables, with ``more`` customers in all."""
        base = 1 / (self.known + 1)
        return (np.maximum(0, sat - self.root_discount * tables) + (ROOT_STRENGTH + self.root_discount * self.root_tables) * base) / (ROOT_STRENGTH + self.root_customers + more)

    def seat_root(self, sat: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        base = (ROOT_STRENGTH + self.root_discount * self.root_tables) / (self.known + 1)
        return seat(sat, lambda at, t: np.full(len(at), base), self.root_discount, rng)


def ways(discount: float, most: int) -> np.ndarray:
    """Logarithms of the weight of all ways to seat n customers at t tables, for n and t up to ``most``."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0
    t = np.arange(1, most + 1)
    for n in range(most):
        old = np.log(np.maximum(n - discount * t, 1e-300)) + out[n, 1:]
        out[n + 1, 1:] = np.logaddexp(out[n, :-1], np.where(t <= n, old, -np.inf))
    return out


def seat(customers: np.ndarray, fresh: Callable[[np.ndarray, np.ndarray], np.ndarray], discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables that all customers of a dish take, drawn given the tables of all others.

    ``fresh`` gives the weight of one more table (for dishes by number, and their tables so far).  Up to ``EXACT``
    customers are drawn at once, by the weight of t tables over all ways to fill them; further ones come one after another, in
    groups of a 32nd of those seated."""
    tables = (customers > 0).astype(np.int64)
    table = ways(discount, EXACT)
    some = np.flatnonzero(customers > 1)
    some = some[np.argsort(-np.minimum(customers[some], EXACT), kind="stable")]
    for first in range(0, len(some), 1 << 16):
        rows = some[first : first + (1 << 16)]
        n = np.minimum(customers[rows], EXACT)
        most = int(n[0])
        weight = table[n, 1 : most + 1]
        total = np.zeros(len(rows))
        for j in range(most):
            upto = int((n > j).sum())
            total[:upto] += np.log(fresh(rows[:upto], np.full(upto, j)))
            weight[:upto, j] += total[:upto]
        chance = np.exp(weight - weight.max(1, keepdims=True)).cumsum(1)
        tables[rows] = 1 + (chance < rng.random(len(rows))[:, None] * chance[:, -1:]).sum(1)
    active, seated = np.flatnonzero(customers > EXACT), EXACT
    while len(active):
        step = max(1, seated // 32)
        t = tables[active]
        f = fresh(active, t)
        come = np.minimum(step, customers[active] - seated)
        tables[active] = t + rng.binomial(come, f / (f + np.maximum(1e-9, seated - discount * t)))
        seated += step
        active = active[customers[active] > seated]
    return tables


#: What parts send.  bucket >= 0: of the contexts of a bucket, in order; SEATING: tables of the words (in
#: customers) and of the pairs; OVERALL: numbers to be summed.  Contexts and customers are sent once.
SENT = "part int, bucket int, context binary, customers binary, tables binary, v array<double>"
SEATING, OVERALL = -1, -2
#: The sweep of what parts get back; CUSTOMERS: of the contexts, alike after each sweep.
CUSTOMERS = -1
BACK = "part int, bucket int, sweep int, words binary, x binary"
#: Of a bucket: its parts in order with the number of contexts each, and which numbers they have.
SHAPE = "bucket int, parts array<int>, sizes array<int>, at binary, customers binary"


def _counts(x: np.ndarray) -> bytes:
    """Counts in 32 bits where they fit, else in 64; the first byte tells."""
    wide = len(x) > 0 and int(np.max(x)) >= 1 << 32
    return bytes([8 if wide else 4]) + np.asarray(x).astype("<i8" if wide else "<u4").tobytes()


def _read_counts(data: bytes | memoryview | pa.Buffer) -> np.ndarray:
    data = memoryview(data).cast("B")
    return np.frombuffer(data[1:], "<i8" if data[0] == 8 else "<u4").astype(np.int64)


def _load(table: pa.Table | pa.RecordBatch, i: int, hot: np.ndarray) -> Part:
    return Part(*_unpack_pairs(table.column("pairs")[i].as_buffer(), "<i8"), table.column("part")[i].as_py(), hot)


def _by_bucket(contexts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts in order of their bucket, and how many each bucket has."""
    bucket = (common.mix64(contexts) % np.uint64(buckets)).astype(np.int64)
    return np.argsort(bucket, kind="stable"), np.bincount(bucket, minlength=buckets)


def _send(part: Part, buckets: int, once: bool = False) -> pa.RecordBatch:
    order, size = _by_bucket(part.contexts, buckets)
    customers, tables = (x[order] for x in part.per_context())
    contexts, end = part.contexts[order], np.cumsum(size)
    rows = [(part.part, b, _blob(contexts[e - k : e], "<u8") if once else None, _counts(customers[e - k : e]) if once else None, _counts(tables[e - k : e]), None) for b, (e, k) in enumerate(zip(end, size, strict=True)) if k]
    rows.append((part.part, SEATING, None, _counts(part.root_tables), _counts(part.tables), None))
    rows.append((part.part, OVERALL, None, None, None, np.concatenate([part.overall(), part.of_hot(), [part.n.sum()]]).tolist()))
    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["part", "bucket", "context", "customers", "tables", "v"])


def _shape(rows: pd.DataFrame) -> pd.DataFrame:
    """Number the contexts of a bucket."""
    rows = rows.sort_values("part")
    contexts = np.concatenate([np.frombuffer(b, "<u8") for b in rows["context"]])
    known, at = np.unique(contexts, return_inverse=True)
    customers = np.bincount(at, weights=np.concatenate([_read_counts(b) for b in rows["customers"]]), minlength=len(known))
    return pd.DataFrame({"bucket": rows["bucket"].iloc[:1].to_numpy(), "parts": [rows["part"].tolist()], "sizes": [[len(b) // 8 for b in rows["context"]]], "at": [_blob(at, "<u4")], "customers": [_blob(customers, "<i8")]})


def _dealt(shape: pd.Series, totals: np.ndarray, sweep: int) -> pd.DataFrame:
    """For each part of a bucket the totals of the contexts that it has."""
    x = totals[np.frombuffer(shape["at"], "<u4")]
    blobs = [_blob(y, "<i8") for y in np.split(x, np.cumsum(shape["sizes"])[:-1])]
    return pd.DataFrame({"part": shape["parts"], "bucket": shape["bucket"], "sweep": sweep, "words": None, "x": blobs})


def _customers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for shapes in batches:
        for _, shape in shapes.iterrows():
            yield _dealt(shape, np.frombuffer(shape["customers"], "<i8"), CUSTOMERS)


def _summed(sweep: int):
    def run(shapes: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        shape = shapes.iloc[0]
        tables = np.concatenate([_read_counts(b) for b in rows.sort_values("part")["tables"]])
        return _dealt(shape, np.bincount(np.frombuffer(shape["at"], "<u4"), weights=tables), sweep)

    return run


def _restored(part: Part, back: pa.Table, sweep: int, buckets: int, overall: tuple[np.ndarray, np.ndarray]) -> Totals:
    """Seat the part as after a sweep; gives the totals of that seating."""
    order, _ = _by_bucket(part.contexts, buckets)
    v = np.zeros((2, len(order)))
    for k, kind in enumerate((CUSTOMERS, sweep)):
        rows = back.filter(pc.equal(back.column("sweep"), kind)).sort_by("bucket")
        get = lambda c, i, t, rows=rows: np.frombuffer(rows.column(c)[i].as_buffer(), t)
        first = int(kind != CUSTOMERS)  # SEATING comes first
        v[k, order] = np.concatenate([get("x", i, "<i8") for i in range(first, rows.num_rows)])
    part.root_tables, part.tables = (_read_counts(rows.column(c)[0].as_buffer()) for c in ("words", "x"))
    return Totals(np.concatenate([*v, overall[0]]), overall[1])


def _first(hot: common.Shipped, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _send(_load(batch, i, hot.get()), buckets, True)

    return run


def _swept(shipped: common.Shipped, buckets: int):
    def run(rows: pa.Table, back: pa.Table) -> pa.Table:
        hot, history = shipped.get()
        part, s = _load(rows, 0, hot), len(history) - 1
        part.sweep(_restored(part, back, s, buckets, history[s]), s)
        return pa.Table.from_batches([_send(part, buckets)])

    return run


def _answers(shipped: common.Shipped, buckets: int):
    """batch, part, probability of each pair asked for, its training count."""

    def run(rows: pa.Table, back: pa.Table) -> pa.Table:
        hot, history = shipped.get()
        part, mean = _load(rows, 0, hot), 0
        samples = range(min(BURN_IN, SWEEPS - 1) + 1, SWEEPS + 1)
        for s in samples:
            model = _restored(part, back, s, buckets, history[s])
            mean = mean + part.predictive(model) / len(samples)
        n = part.counts(model)
        step = np.frombuffer(_unpack(rows.column("asked")[0].as_buffer())[0], "<u4")
        asks = rows.column("asks")[0].as_py()
        parts = [np.cumsum(x.astype(np.int64)) for x in np.split(step, np.cumsum([a["size"] for a in asks])[:-1])]
        columns = [a["batch"] for a in asks], [part.part] * len(asks), [_blob(np.log10(mean[x]), "<f4") for x in parts], [_pack(_blob(n[x], "<u8")) for x in parts]
        types = (pa.string(), pa.int32(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["batch", "part", "score", "n"])

    return run


def _scored(total: float, known: float):
    """Put a batch's answers, in order of part, to its documents."""

    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        answers = answers.sort_values("part")
        score = np.concatenate([np.frombuffer(b, "<f4") for b in answers["score"]]).astype(float)
        n = np.concatenate([np.frombuffer(_unpack(b)[0], "<u8") for b in answers["n"]]).astype(float)
        base = np.log10((n + 1) / (total + known + 1))
        ids, out, tokens = np.frombuffer(docs["ids"].iloc[0], "<i8").reshape(3, -1)
        number = np.frombuffer(docs["pairs"].iloc[0], "<u4")
        first = np.concatenate([[0], np.cumsum(tokens)[:-1]])
        add = lambda x: np.add.reduceat(x[number], first)
        return pd.DataFrame({"row": ids, "held_out": out.astype(bool), "n_tokens": tokens, "n_known": add((n > 0).astype(np.int64)), "train_tokens": int(total), "base_score": add(base), "score": add(score)})

    return run


class _Tables:
    """Bucketed tables inside a workspace: kept by a key, so that no grouping by it moves the rows again."""

    def __init__(self, work: common.Workspace) -> None:
        self.work, self.names = work, []

    def write(self, df: DataFrame, n: int, key: str, what: str, by: tuple[str, ...] = ()) -> DataFrame:
        name = f"lm_{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd").option("path", f"{self.work.path}/{what}").bucketBy(n, key)
        (writer.partitionBy(*by) if by else writer).saveAsTable(name)
        self.names.append(name)
        return df.sparkSession.table(name)

    def write_all(self, parts: Iterator[DataFrame], n: int, key: str, what: str) -> DataFrame:
        """One table of several frames, each of which is written before the next is asked for."""
        name = f"lm_{uuid.uuid4().hex}"
        for df in parts:
            df.write.mode("append").option("compression", "zstd").option("path", f"{self.work.path}/{what}").bucketBy(n, key).saveAsTable(name)
        self.names.append(name)
        return self.work.spark.table(name)

    def drop(self) -> None:
        for name in self.names:
            self.work.spark.sql(f"drop table {name}")


def _overall(sent: DataFrame, hot: np.ndarray, before: tuple | None, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The overall numbers of a seating, (customers in the parent, tokens, parent's tables) of the hot words, and the tokens."""
    rows = sent.where(F.col("bucket") == OVERALL).select(F.posexplode("v").alias("i", "x"))
    got = rows.groupBy("i").agg(F.sum("x").alias("x")).toArrow()  # a bounded number
    v = np.zeros(8 + 2 * len(hot))
    v[got.column("i").to_numpy()] = got.column("x").to_numpy()
    overall, (sat, count) = v[:7], v[7:-1].reshape(2, -1).astype(np.int64)
    if before is None:
        tables = (count > 0).astype(np.int64)
    else:
        tables = Totals(before[0]).seat_root(sat, np.random.default_rng([seed, 1 << 31]))
    overall += 0, tables.sum(), (count > 0).sum(), 0, 0, (sat == 1).sum(), (sat == 2).sum()
    return overall, np.concatenate([sat, count, tables]), v[-1]


def _back(sent: DataFrame, shapes: DataFrame, sweep: int) -> DataFrame:
    tables = sent.where(F.col("bucket") >= 0).select("part", "bucket", "tables")
    totals = shapes.select("bucket", "parts", "sizes", "at").groupBy("bucket").cogroup(tables.groupBy("bucket")).applyInPandas(_summed(sweep), BACK)
    seating = sent.where(F.col("bucket") == SEATING).select("part", "bucket", F.lit(sweep).alias("sweep"), F.col("customers").alias("words"), F.col("tables").alias("x"))
    return totals.union(seating)


def score(docs: DataFrame, held_out: F.Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity (of the model, per token).

    Documents for which ``held_out`` holds are scored but not learnt from.  doc_id must be integral."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    volume = source.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    parts = max(8, int(volume / 6 / 3 / PART_PAIRS * 4) + 1)
    buckets = max(8, parts // 4)
    hot = frequent_words(source.where(~F.col("held_out")))
    missing_id = F.lit(-(1 << 62))  # a null id comes back as null
    with common.Workspace(spark, "lm") as work:
        tables = _Tables(work)
        packed = source.withColumn("doc_id", F.coalesce("doc_id", missing_id)).mapInArrow(_batches(common.Shipped(spark, hot), parts), BATCH)
        packed = tables.write(packed, parts, "batch", "batches", ("kind",))

        def goes() -> Iterator[DataFrame]:
            for g in range(1, GROUPS + 1):
                rows = packed.where(F.col("kind") == g).select("batch", "part", "size", "pairs")
                yield rows.repartition(-(-parts // GROUPS), "part").groupBy("part").applyInPandas(_merge, PART)
                work.remove(f"batches/kind={g}")
                work.release()

        merged = tables.write_all(goes(), parts, "part", "parts")
        with common.Workspace(spark, "lm-first") as own:
            sent = own.write(merged.mapInArrow(_first(common.Shipped(spark, hot), buckets), SENT), "sent")
            shapes = sent.where(F.col("bucket") >= 0).select("part", "bucket", "context", "customers").repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_shape, SHAPE)
            shapes = tables.write(shapes, buckets, "bucket", "contexts")
            customers = work.write(shapes.mapInPandas(_customers, BACK), "customers")
            history, back = [_overall(sent, hot, None, 0)], [work.write(_back(sent, shapes, 0), "back")]
        for s in range(SWEEPS):
            with common.Workspace(spark, "lm-sweep") as own:
                swept = merged.groupBy("part").cogroup(customers.union(back[s]).groupBy("part")).applyInArrow(_swept(common.Shipped(spark, (hot, [h[:2] for h in history])), buckets), SENT)
                sent = own.write(swept, "sent")
                history.append(_overall(sent, hot, history[-1], s))
                back.append(work.write(_back(sent, shapes, s + 1), "back"))
            work.release()
        total, known = history[0][2], history[0][0][2]
        late = functools.reduce(DataFrame.union, back[min(BURN_IN, SWEEPS - 1) + 1 :], customers)
        answers = merged.groupBy("part").cogroup(late.groupBy("part")).applyInArrow(_answers(common.Shipped(spark, (hot, [h[:2] for h in history])), buckets), "batch string, part int, score binary, n binary")
        found = packed.where(F.col("kind") == 0).select("batch", "pairs", "ids").groupBy("batch").cogroup(answers.groupBy("batch"))
        scored = found.applyInPandas(_scored(total, known), "row long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
        scored = common.materialise(scored, "lm-scores")
        tables.drop()
    doc_id = F.when(F.col("row") != missing_id, F.col("row"))
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return scored.select(doc_id.alias("doc_id"), *scored.columns[1:], perplexity.alias("perplexity"))


def report(docs: DataFrame) -> DataFrame:
    return score(docs, common.remainder("doc_id", 7) == 2)
