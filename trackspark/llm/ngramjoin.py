"""Operator 10: n-gram Jaccard join by token-combination prefixes.

A document is its set of hashed word shingles (the tokens).  Tokens have one global order: rare ones
first, by hash, then frequent ones, by hash.  With at most ``m`` tokens missing from a partner, a
document's prefix is taken so long that a partner must share a signature of it:

* if ``m + 1`` rare tokens exist, these are the prefix, and each is a signature by itself;
* else the prefix is extended into the frequent tokens, which are dealt into groups by hash, and the
  signatures are the rare tokens and all pairs of frequent tokens of one group.  A pair that shares no
  signature shares at most one frequent token of each group, so the prefix goes on until its tokens
  minus its groups come to ``m + 1``.  The number of groups follows from the band of set sizes (powers
  of two); documents near the top of a band are indexed in the next one, too.

Which tokens are frequent (in about ``FREQUENT`` documents or more) steers cost, never results.  They
are found by counts within chunks of all documents, summed; those below ``LEAST`` in a chunk are summed for the first tokens of
each set only, from which prefixes are taken: else a token that is spread thinly over many chunks would stay rare, and its list would grow with
the corpus.  At most ``MAX_FREQUENT`` tokens, the most frequent, are broadcast (8 bytes each), the others count as rare.

Documents with equal sets form one class and go on as one row.  Two classes in a list of up to ``SMALL`` are a
pair when the number of lists they share allows the similarity: of the two prefixes one ends first, and
what it holds up to there is either shared and counted or missing in the partner.  Pairs are verified by intersecting their
sets: first one pair for each class, then the pairs that do not hang together by these links.

Longer lists come from large groups of near copies: classes that share one are put into one cluster, cut
into blocks of about ``BLOCK`` classes or ``BLOCK_TOKENS`` tokens.  Every class is first compared with a few hubs of
its cluster.  Those linked to the same hub need not be compared with each other: only classes apart from the most
linked hub of their cluster go on, in blocks, against all blocks; each pair of blocks counts all its intersections at once,
as a product of 0/1 matrices, of which only the links that connect its classes leave the task.  Pairs of blocks take turns in
rounds, in each of which about as many tokens are sent as all sets hold.  Links become components
by alternating large and small stars.  All of it runs as joins and aggregates on shared storage; nothing
that grows with the corpus comes to the driver, and the tables in between go when the components are known.

Verification intersects the 64-bit hashes of all shingles.

Cases: null, empty or wordless texts have an empty set, are linked with nothing and are their own
component; fewer words than a shingle are one shingle; equal sets are linked; a null doc_id has no
part in the smallest id of a component; repeated rows are linked to each other; other columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORDS = 3
#: The similarity at least, in hundredths.
PERCENT = 90
FREQUENT = 100
#: Tokens of a chunk within which document frequencies are counted, and the least count that is summed.
CHUNK = 3_000_000
LEAST = 3
#: The first tokens of a set, as multiples of what it may lack, are counted however rare they are in a chunk: prefixes are
#: taken from them, and the counts that chunks leave out grow with their number.
EARLY = 2
#: Rows of a batch of their counts.
AT_ONCE = 100_000
MAX_FREQUENT = 2_000_000
SMALL = 128
BLOCK = 1000
#: Tokens of a block, about.
BLOCK_TOKENS = 500_000
#: Tokens that are sent to pairs of blocks in a round, at least; more if the sets of all classes hold more.
ROUND_TOKENS = 16_000_000
HUBS = 3
#: Columns of a 0/1 matrix at a time.
COLUMNS = 4096
#: Room for more strata than there are sizes.
STRATA_BITS = 9
#: Rows of an id or two up to which a side is broadcast; beyond, the texts are joined by a shuffle.
BROADCAST_ROWS = 500_000


def token_set(text, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    w = common.hash_words(common.as_bytes(text))
    if not len(w):
        return w
    size = min(words, len(w))
    out = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        out = common.mix64(out * np.uint64(0x9FB21C651E98DF25) + w[i : len(w) - size + 1 + i])
    return np.unique(out)


def missing(n: int, percent: int) -> int:
    """How many of n tokens a partner may lack."""
    return n * (100 - percent) // 100


def prefix(tokens: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int, int]:
    """64-bit signatures of a set: single rare tokens, combined pairs of frequent ones; how many are single; and
    the last single one, in an order that is that of long (the greatest if the prefix goes on after the rare tokens)."""
    n = len(tokens)
    need = missing(n, percent) + 1
    last = (1 << 63) - 1
    # a partner that lacks something must have a union of n + 1 at least
    if n * 100 < percent * (n + 1):
        return tokens[:0], 0, last
    if len(frequent):
        at = np.searchsorted(frequent, tokens).clip(0, len(frequent) - 1)
        known = frequent[at] == tokens
        rare, often = tokens[~known], tokens[known]
    else:
        rare, often = tokens, tokens[:0]
    if len(rare) >= need:
        return rare[:need], need, int(rare[need - 1]) - (1 << 63)
    out = [rare]
    band = n.bit_length() - 1
    for b in (band, band + 1) if n * 100 // percent >= 1 << (band + 1) else (band,):
        groups = max(1, (1 << b) // 8)
        group = (common.mix64(often) % np.uint64(groups)).astype(np.int64)
        first = np.zeros(len(often), np.int64)
        first[np.unique(group, return_index=True)[1]] = 1
        enough = np.flatnonzero(np.arange(1, len(often) + 1) - np.cumsum(first) >= need - len(rare))
        end = enough[0] + 1 if len(enough) else len(often)
        order = np.argsort(group[:end], kind="stable")
        bounds = np.flatnonzero(np.diff(group[:end][order], prepend=-1, append=-1))
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            part = often[:end][order[s:e]]
            i, j = np.triu_indices(len(part), 1)
            out.append(common.mix64(common.mix64(part[i] + np.uint64(b)) * np.uint64(3) + part[j]))
    return np.concatenate(out), len(rare), last


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return prefix(tokens, frequent, percent)[0]


def _often(tokens: np.ndarray) -> pa.RecordBatch:
    """The tokens that occur LEAST times or more, with their counts.  Sorts in place: a chunk is held once."""
    tokens.sort()
    last = max(0, len(tokens) - LEAST + 1)
    first = tokens[:last] == tokens[LEAST - 1 :]
    first[1:] &= tokens[1:last] != tokens[: max(0, last - 1)]
    start = np.flatnonzero(first)
    found = tokens[start]
    return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.searchsorted(tokens, found, "right") - start, pa.int64())], ["token", "n"])


def _others(early: list[np.ndarray], counted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The early tokens of a chunk that are not counted yet, with their counts."""
    token, n = np.unique(np.concatenate(early), return_counts=True)
    if len(counted):
        other = counted[np.searchsorted(counted, token).clip(0, len(counted) - 1)] != token
        token, n = token[other], n[other]
    for i in range(0, len(token), AT_ONCE):
        yield pa.RecordBatch.from_arrays([pa.array(token[i : i + AT_ONCE].view(np.int64)), pa.array(n[i : i + AT_ONCE], pa.int64())], ["token", "n"])


def _frequencies(words: int, percent: int | None = None):
    """Counts of tokens by chunk: of those that occur LEAST times or more in it, and with ``percent`` of all that are early in a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.unload()
        held, size, early = np.empty(CHUNK, np.uint64), 0, []

        def counts() -> Iterator[pa.RecordBatch]:
            yield (often := _often(held[:size]))
            if early:
                yield from _others(early, often.column(0).to_numpy().view(np.uint64))

        for batch in batches:
            for text in batch.column(0):
                tokens = token_set(text, words)
                if size + len(tokens) > len(held):
                    held.resize(size + len(tokens), refcheck=False)
                held[size : size + len(tokens)] = tokens
                size += len(tokens)
                if percent is not None:
                    early.append(tokens[: EARLY * (missing(len(tokens), percent) + 1)].copy())
                if size >= CHUNK:
                    yield from counts()
                    size, early = 0, []
        yield from counts()

    return run


def frequent_tokens(docs: DataFrame, words: int, percent: int, frequent: int, work: common.Workspace) -> np.ndarray:
    """Sorted hashes of the tokens that are in about ``frequent`` documents or more."""
    counted = docs.select("text").mapInArrow(_frequencies(words, percent), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    # half, as counts below LEAST within a chunk are summed for early tokens only
    often = work.write(counted.where(F.col("n") >= max(LEAST, frequent // 2)), "frequent-tokens")
    if often.count() > MAX_FREQUENT:
        often = often.orderBy(F.desc("n"), "token").limit(MAX_FREQUENT)
    return np.sort(often.select("token").toArrow().column("token").to_numpy().view(np.uint64))


def _class_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


DESCRIBED = "cls binary, n long, single long, last long, keys array<long>"


def _described(shipped: common.Shipped, words: int, percent: int):
    """(doc_id, copy, text) to doc_id, copy and DESCRIBED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shipped.get()
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(2):
                tokens = token_set(text, words)
                if not len(tokens):
                    rows.append((None, 0, 0, 0, []))
                    continue
                keys, single, last = prefix(tokens, frequent, percent)
                rows.append((_class_of(tokens), len(tokens), single, last, keys.view(np.int64)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "copy", "cls", "n", "single", "last", "keys"])

    return run


def _sets(words: int):
    """(id, cls, n, text) to id, n, tokens where the text has the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for cls, text in zip(batch.column(1), batch.column(3), strict=True):
                tokens = token_set(text, words)
                blobs.append(tokens.tobytes() if _class_of(tokens) == cls.as_py() else None)
            tokens = pa.array(blobs, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), tokens], ["id", "n", "tokens"]).filter(tokens.is_valid())

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [_linked(np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8"), percent) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["x", "y"]).filter(pa.array(good, pa.bool_()))

    return run


def _fits(small: F.Column, large: F.Column, percent: int) -> F.Column:
    return small * 100 >= large * percent


def counted_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of classes in lists of up to SMALL, where the lists they share allow the similarity.

    shared: key, m (classes in the list), id, n, single, last."""
    # tokens that two classes share in long lists are not counted here
    long = shared.where(F.col("m") > SMALL).groupBy("id").agg(F.count(F.lit(1)).alias("long"))
    short = shared.where(F.col("m") <= SMALL).join(long, "id", "left").withColumn("long", F.coalesce("long", F.lit(0)))
    lists = short.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "id", "single", "last", "long"))).alias("of"))
    p = F.col("p")

    def pair(q: F.Column) -> F.Column:
        needed = F.ceil(percent * (p["n"] + q["n"]) / (100 + percent))
        beyond = lambda c: c["n"] - c["single"]
        most = F.when(p["last"] < q["last"], beyond(p)).when(p["last"] > q["last"], beyond(q)).otherwise(F.least(beyond(p), beyond(q)))
        return F.struct(F.least(p["id"], q["id"]).alias("x"), F.greatest(p["id"], q["id"]).alias("y"), (needed - F.least(p["long"], q["long"]) - most).cast("int").alias("least"))

    after = F.filter(F.slice("of", F.col("i") + 2, F.lit(SMALL)), lambda q: _fits(p["n"], q["n"], percent) & (p["id"] != q["id"]))
    some = lists.select("of", F.posexplode("of").alias("i", "p")).select(F.explode(F.transform(after, pair)).alias("q")).select("q.*")
    return some.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"), F.max("least").alias("least")).where(F.col("c") >= F.col("least")).select("x", "y")


def token_sets(source: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """id, n, tokens of the wanted classes.  wanted: id, cls, n, rep (doc_id and copy of one of its documents)."""
    wanted = wanted.select("id", "cls", "n", F.col("rep.doc_id").alias("_op_doc"), F.col("rep.copy").alias("_op_copy"))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    met = source.join(wanted, source["doc_id"].eqNullSafe(F.col("_op_doc")) & (source["copy"] == F.col("_op_copy")))
    found = met.select("id", "cls", "n", "text").mapInArrow(_sets(words), "id long, n long, tokens binary")
    return found.groupBy("id", "n").agg(F.first("tokens").alias("tokens"))  # of repeated rows, one


def verified_pairs(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs that are links.  known: id, n, tokens."""
    side = lambda k: known.select(F.col("id").alias(k), F.col("tokens").alias(f"t{k}"))
    return pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "tx", "ty").mapInArrow(_verified(percent), "x long, y long")


def pair_links(pairs: DataFrame, known: DataFrame, percent: int, work: common.Workspace) -> DataFrame:
    """Links with the components of all pairs that are similar: one pair of each class first, then what is apart."""
    one = pairs.groupBy("y").agg(F.min("x").alias("x")).select("x", "y")
    links = work.write(verified_pairs(one, known, percent), "jaccard-first")
    # two steps up along these links; pairs that meet there hang together already
    up = links.select(F.col("y").alias("id"), F.col("x").alias("up"))
    tops = up.join(up.select(F.col("id").alias("up"), F.col("up").alias("top")), "up", "left").select("id", F.coalesce("top", "up").alias("top"))
    side = lambda k: tops.select(F.col("id").alias(k), F.col("top").alias(f"t{k}"))
    apart = pairs.join(side("x"), "x", "left").join(side("y"), "y", "left").where(F.coalesce("tx", "x") != F.coalesce("ty", "y"))
    apart = apart.select("x", "y").join(one, ["x", "y"], "left_anti")
    return links.union(work.write(verified_pairs(apart, known, percent), "jaccard-second"))


# --- clusters of long lists ----------------------------------------------------------------------------


def _hub_links(percent: int):
    """Links of the classes of a block to the hubs of its cluster."""

    def run(rows: pd.DataFrame, hubs: pd.DataFrame) -> pd.DataFrame:
        sets = [(i, np.frombuffer(t, "<u8")) for i, t in zip(hubs["hub"], hubs["hub_tokens"], strict=True)]
        found = [(hub, i) for i, t in zip(rows["id"], rows["tokens"], strict=True) for hub, h in sets if hub != i and _linked(np.frombuffer(t, "<u8"), h, percent)]
        return pd.DataFrame(found, columns=["x", "y"], dtype="int64")

    return run


def _block_links(percent: int):
    """Links that connect what is connected in a pair of blocks."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(t, "<u8") for t in rows["tokens"]]
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        token, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), n)
        keep = count[column] > 1  # the others are in no intersection
        row, column = row[keep], (np.cumsum(count > 1) - 1)[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        width = int((count > 1).sum())
        for first in range(0, width, COLUMNS):
            s, e = np.searchsorted(column, [first, first + COLUMNS])
            part = np.zeros((len(sets), min(COLUMNS, width - first)), np.float32)
            part[row[s:e], column[s:e] - first] = 1
            both += part @ part.T
        linked = np.empty(both.shape, bool)
        strips = [slice(i, i + 256) for i in range(0, len(n), 256)]
        for i in strips:
            inner = both[i].astype(np.int64)
            linked[i] = 100 * inner >= percent * (n[i, None] + n[None, :] - inner)
        np.fill_diagonal(linked, True)
        del both
        label = np.arange(len(n), dtype=np.int32)
        while True:  # every class takes the least label that it is linked to
            least = np.concatenate([np.where(linked[i], label[None, :], np.int32(len(n))).min(1) for i in strips])
            least = least[least]
            if (least == label).all():
                break
            label = least
        names = rows["id"].to_numpy()
        tied = np.flatnonzero(label != np.arange(len(n)))
        return pd.DataFrame({"x": names[tied], "y": names[label[tied]]})

    return run


def _blocked(members: DataFrame, name: str) -> DataFrame:
    """members (comp, id, n) with their block, and the number of blocks of the cluster as ``name``."""
    size = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_TOKENS)).cast("int")
    return members.join(members.groupBy("comp").agg(size.alias(name)), "comp").withColumn("own", F.pmod(F.xxhash64("id"), F.col(name)).cast("int"))


def cluster_links(large: DataFrame, known: DataFrame, percent: int, work: common.Workspace) -> DataFrame:
    """Links within the clusters of classes that share long lists.  large: key, id, n; known: id, n, tokens.

    Sizes are cut into strata so that partners are in the same one or the next: each class joins the
    clusters of its stratum and of the one below."""
    stratum = F.floor(F.log(F.col("n").cast("double")) / -np.log(percent / 100))
    placed = large.select("key", F.explode(F.array(stratum, stratum - 1)).alias("g"), "id", "n")
    # a class in a stratum is one node
    placed = placed.select("key", "g", "n", (F.shiftleft("id", STRATA_BITS) + F.pmod("g", F.lit(1 << STRATA_BITS))).alias("node"))
    hubs = placed.groupBy("key", "g").agg(F.min("node").alias("y"))
    ties = placed.join(hubs, ["key", "g"]).select(F.col("node").alias("x"), "y").where(F.col("x") != F.col("y")).distinct()
    found = components(ties, work).withColumn("id", F.shiftright("cls", STRATA_BITS)).join(known.select("id", "n"), "id").select("comp", "id", "n")
    found = work.write(_blocked(found, "blocks"), "jaccard-clusters")

    # a few hubs of each cluster, those of least hash, meet every block
    least = found.groupBy("comp").agg(F.max("blocks").alias("blocks"))
    order = F.struct(F.xxhash64("id", "comp").alias("h"), "id")
    chosen = found.groupBy("comp", "own").agg(F.min(order).alias("o")).groupBy("comp").agg(F.slice(F.array_sort(F.collect_list("o")), 1, HUBS).alias("o"))
    hub = chosen.select("comp", F.explode("o").alias("o")).select("comp", F.col("o.id").alias("id")).join(known.select("id", "tokens"), "id").withColumnRenamed("id", "hub")
    hub = work.write(hub, "jaccard-hub-sets")
    meets = hub.join(least, "comp").withColumn("own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("comp", "own", "hub", F.col("tokens").alias("hub_tokens"))
    members = found.select("comp", "own", "id").join(known.select("id", "tokens"), "id")
    first = members.groupBy("comp", "own").cogroup(meets.groupBy("comp", "own")).applyInPandas(_hub_links(percent), "x long, y long")
    first = work.write(first, "jaccard-hubs")

    # what is not linked to the cluster's most linked hub goes against all blocks
    to = found.select("comp", "id").join(first.select(F.col("x").alias("hub"), F.col("y").alias("id")), "id").join(hub.select("comp", "hub"), ["comp", "hub"])
    top = to.groupBy("comp", "hub").agg(F.count(F.lit(1)).alias("c")).groupBy("comp").agg(F.max(F.struct("c", "hub")).alias("top")).select("comp", F.col("top.hub").alias("hub"))
    near = to.join(top, ["comp", "hub"]).select("comp", "id").union(top.select("comp", F.col("hub").alias("id")))
    apart = _blocked(found.select("comp", "id", "n").join(near, ["comp", "id"], "left_anti"), "rest")
    apart = work.write(apart, "jaccard-apart")
    rest = apart.groupBy("comp").agg(F.max("rest").alias("rest"))
    others = found.join(apart.select("comp", "id"), ["comp", "id"], "left_anti").join(rest, "comp")
    # kind 0: a block of the rest with a block of the others; kind 1: two blocks of the rest
    spread = apart.join(found.groupBy("comp").agg(F.max("blocks").alias("blocks")), "comp")
    rows = others.select("id", "comp", F.lit(0).alias("kind"), F.explode(F.sequence(F.lit(0), F.col("rest") - 1)).alias("i"), F.col("own").alias("j"))
    rows = rows.union(spread.select("id", "comp", F.lit(0), F.col("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    within = apart.select("id", "comp", "own", F.explode(F.sequence(F.lit(0), F.col("rest") - 1)).alias("other"))
    rows = rows.union(within.select("id", "comp", F.lit(1), F.least("own", "other"), F.greatest("own", "other")))
    # sets are sent to their pairs of blocks in rounds, so that what lies on disk at once follows the sets, not the pairs
    sent = rows.join(known.select("id", "n"), "id").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    held = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rounds = -(-sent // max(held, ROUND_TOKENS))
    turn = F.pmod(F.xxhash64("comp", "kind", "i", "j"), F.lit(rounds))
    found = first
    for k in range(rounds):
        blocks = rows.where(turn == k).join(known.select("id", "tokens"), "id")
        links = blocks.groupBy("comp", "kind", "i", "j").applyInPandas(_block_links(percent), "x long, y long")
        found = found.union(work.write(links, "jaccard-blocks"))
    return found


def components(links: DataFrame, work: common.Workspace) -> DataFrame:
    """cls, comp (the smallest class of the component) for every class with a link, by alternating stars."""
    edges = links.select(F.col("x").alias("a"), F.col("y").alias("b"))
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours go to the smallest one known
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        # small star: smaller neighbours and the node itself go to the smallest neighbour
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        edges = work.write(small.where(F.col("a") != F.col("b")).distinct(), "stars")
        # done when all hangs on roots that hang on nothing, and nothing changes any more
        after = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            return edges.select(F.col("a").alias("cls"), F.col("b").alias("comp")).union(edges.select(F.col("b").alias("cls"), F.col("b").alias("comp")).distinct())
        before = after


def classes_and_links(docs: DataFrame, work: common.Workspace, words: int = WORDS, percent: int = PERCENT, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, copy, cls, n of every document; cls, comp of every class that has links), in ``work``."""
    spark = docs.sparkSession
    source = docs.select("doc_id", F.xxhash64("text").alias("copy"), "text")
    shipped = common.Shipped(spark, frequent_tokens(source, words, percent, frequent, work))
    rows = work.write(source.mapInArrow(_described(shipped, words, percent), common.extended(source.select("doc_id", "copy"), DESCRIBED)), "jaccard-rows")
    full = rows.where(F.col("cls").isNotNull())
    # one row per class, numbered once it is written: numbers are shorter than hashes in what follows
    first = [F.first(c).alias(c) for c in ("n", "single", "last", "keys")]
    classes = full.groupBy("cls").agg(F.min(F.struct("doc_id", "copy")).alias("rep"), *first)
    classes = work.write(classes.withColumn("id", F.monotonically_increasing_id()), "jaccard-classes")

    index = classes.select("id", F.explode("keys").alias("key"))
    sized = index.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1)
    shared = work.write(index.join(sized, "key").join(classes.select("id", "n", "single", "last"), "id"), "jaccard-index")
    pairs = work.write(counted_pairs(shared, percent), "jaccard-pairs")
    large = shared.where(F.col("m") > SMALL).select("key", "id", "n")

    # token sets, of one document of each class that is in a pair or a long list
    used = pairs.select(F.col("x").alias("id")).union(pairs.select(F.col("y").alias("id"))).union(large.select("id")).distinct()
    known = work.write(token_sets(source, used.join(classes.select("id", "cls", "n", "rep"), "id"), words), "jaccard-sets")
    links = pair_links(pairs, known, percent, work)
    if not large.isEmpty():
        links = links.union(cluster_links(large, known, percent, work))
    links = work.write(links.distinct(), "jaccard-links")
    tied = components(links, work).withColumnRenamed("cls", "id").join(classes.select("id", "cls"), "id")
    return rows.select("doc_id", "copy", "cls", "n"), work.write(tied.select("cls", "comp"), "jaccard-components")


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links lead to, itself included."""
    with common.Workspace(docs.sparkSession, "jaccard", releases=True) as work:
        rows, joined = classes_and_links(docs, work, words, percent)
        least = rows.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("doc_id").alias("least"))
        placed = least.join(joined, "cls", "left")
        ids = placed.where(F.col("comp").isNotNull()).groupBy("comp").agg(F.min("least").alias("component_id"))
        by_class = work.write(placed.join(ids, "comp", "left").select("cls", F.coalesce("component_id", "least").alias("component_id")), "ids")
        found = rows.join(by_class, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
        return common.materialise(found, "jaccard-found")


def keep_one(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """One row of each component, with all columns of ``docs``: that of the smallest id (null: the last), then of the smallest
    hash of its text.

    A row is known by its id and text, so rows that share an id may stay beside each other; rows that repeat
    both stay once; rows without words all stay."""
    spark = docs.sparkSession
    with common.Workspace(spark, "jaccard", releases=True) as work:
        rows, joined = classes_and_links(docs, work, words, percent)
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")
        least = rows.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min(order).alias("least"))
        placed = least.join(joined, "cls", "left").withColumn("group", F.coalesce(F.col("comp").cast("string"), F.hex("cls")))
        best = placed.groupBy("group").agg(F.min("least").alias("best"))
        by_class = work.write(placed.join(best, "group").select("cls", "best"), "best")
        gone = rows.join(by_class, "cls").where(~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("copy") == F.col("best.copy"))))
        gone = common.materialise(gone.select(F.col("doc_id").alias("_op_doc"), F.col("copy").alias("_op_copy")).distinct(), "jaccard-gone")
        twice = rows.where(F.col("cls").isNotNull()).groupBy("doc_id", "copy").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count()
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    columns = docs.columns
    copy = F.xxhash64(docs["text"])
    left = docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_op_doc")) & (copy == F.col("_op_copy")), "left_anti")
    if twice:
        wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
        left = left.withColumn("_op_n", F.when(wordless, 1).otherwise(F.row_number().over(same))).where("_op_n = 1")
    return left.select(*[F.col(f"`{c}`") for c in columns])


#: Another engine's SQL: pairs that share a shingle are counted, links closed by recursion.
SQL = r"""
with recursive _d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
_s as (select distinct rid, array_to_string(w[i:i + least({words}, len(w)) - 1], ' ') as t from (select rid, w, unnest(range(1, greatest(1, len(w) - {words} + 1) + 1)) as i from _d where len(w) > 0)),
_n as (select rid, count(*) as n from _s group by rid),
_both as (select a.rid as x, b.rid as y, count(*) as k from _s a join _s b on a.t = b.t and a.rid <> b.rid group by a.rid, b.rid),
_links as (select x, y from _both join _n a on a.rid = x join _n b on b.rid = y where 100 * k >= {percent} * (a.n + b.n - k)),
_reach(a, b) as (select rid, rid from _d union select r.a, l.y from _reach r join _links l on r.b = l.x),
_comp as (select r.a as rid, min(d.doc_id) as component_id from _reach r join _d d on d.rid = r.b group by r.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.component_id, d.doc_id) as component_id from _d d left join _n n using (rid) left join _comp c using (rid)
""".format(words=WORDS, percent=PERCENT)
