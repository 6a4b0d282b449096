"""Operator 1: suffix-array dedup of long repeated byte strings, built column by column.

A byte is removed if it lies in a string of ``LENGTH`` bytes that also starts somewhere else, in
the same document or another one.

Construction.  A collection of strings is indexed by inserting one symbol per string each round, from
the last column to the first.  After a round the suffixes that begin in its column stand in
lexicographic order; the symbols inserted next, in that order, are the round's stretch of the collection's
Burrows-Wheeler transform, and sorting by them (keeping the order otherwise) gives the next order.  The
common prefixes of neighbours follow as one more than the least between their former places.  Both are
only read and written from front to back, as sequential files are; here they are arrays of one round,
as a collection is of bounded size.  A suffix repeats when the common prefix with a neighbour has
``LENGTH`` symbols.

Collections.  Equal strings must meet, so texts are cut by content: each window of LENGTH bytes has an
anchor, the ``ANCHOR``-byte string in it with the least hash.  Windows next to each other with the same
anchor form a segment.  Equal windows have equal anchors in the same place, so all segments of one
anchor are aligned at it, and the rounds go over those columns.  Only the anchors that occur twice or more
make collections.  Of segments that are equal as a whole two take part, however many there are; what is found for
them holds for the others.

Hot anchors, of over ``HOT`` different segments, are cut into bands of columns, each keyed by the bytes that all
its windows share, without losing an equal pair: into two bands first, and those that are still hot into
narrower ones, down to one column, where the key is the string itself and is only counted.  Pieces of a
band that are equal as a whole need not go deeper.

Passages.  The report also counts passages: runs of over ``PASSAGE_WORDS`` words in strings of ``PASSAGE``
bytes that start again elsewhere.  They are found first, in all texts.  A string of LENGTH bytes that repeats lies in such
a run, so the strings of LENGTH are then found in the runs alone.

Everything runs as joins and aggregates over hashes; the texts are written once to a table bucketed by
the task that wrote them, so that fetching segments and removing bytes needs no shuffle of texts.  Tables in
between go when the result is written.

Cases: null text is empty; documents shorter than LENGTH keep everything; equal documents of LENGTH or
more lose everything; a string that overlaps itself counts as repeated; repeated rows are documents of
their own; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH = 400
PASSAGE = 256
PASSAGE_WORDS = 50
ANCHOR = 32
#: Window starts handled at once; positions must fit the low bits of a key.
PIECE = 900_000
LOW = 20
#: Bytes of short texts that are hashed in one go.
TOGETHER = 1 << 15
#: Rows of a batch that are cut at a time.
AT_ONCE = 500
HOT = 2_000
#: Bytes of segments in one collection, about.
COLLECTION = 12 << 20
#: Spark makes no more buckets than this (``spark.sql.sources.bucketing.maxBuckets``); up to it there is one for each task that reads texts.
MAX_BUCKETS = 100_000
#: A band is cut into so many narrower ones.
FINER = 8


# --- cutting texts into segments ------------------------------------------------------------------


def _minima(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix hashes, hashes of the anchors, and the place of each window's anchor."""
    k = min(ANCHOR, length)
    span, n = length - k + 1, len(data) - length + 1  # anchors in a window, windows
    prefix = common.prefix_hash(data)
    first = np.arange(len(data) - k + 1)
    h = common.span_hash(prefix, first, first + k)
    # least of each span: high bits of the hash, then the leftmost place
    key = (h & ~np.uint64((1 << LOW) - 1)) | first.astype(np.uint64)
    pad = np.full(-len(key) % span, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate([key, pad]).reshape(-1, span)
    before = np.minimum.accumulate(blocks, axis=1).ravel()[span - 1 : span - 1 + n]
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return prefix, h, (np.minimum(before, after) & np.uint64((1 << LOW) - 1)).astype(np.int64)


def segments(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(anchor hash, segment hash, start, windows, anchor's place in the segment) of a text's segments."""
    windows = len(data) - length + 1
    if windows < 1:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    out = []
    for at in range(0, windows, PIECE):
        n = min(PIECE, windows - at)
        prefix, h, place = _minima(data[at : at + n + length - 1], length)
        start = np.flatnonzero(np.diff(place, prepend=-1))
        count = np.diff(start, append=n)
        whole = common.span_hash(prefix, start, start + count + length - 1)
        out.append((h[place[start]], common.mix64(whole + count.astype(np.uint64)), start + at, count, place[start] - start))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def segments_of(texts: list[np.ndarray], length: int = LENGTH) -> list[tuple[np.ndarray, ...]]:
    """``segments`` of each text; short ones are hashed together, as a call for each costs more than their bytes."""
    out: list[tuple[np.ndarray, ...]] = [()] * len(texts)
    group: list[int] = []
    size = 0
    for i, data in enumerate(texts):
        if len(data) < length or len(data) > TOGETHER:
            out[i] = segments(data, length)
            continue
        if size + len(data) > TOGETHER:
            _together(texts, group, length, out)
            group, size = [], 0
        group.append(i)
        size += len(data)
    if group:
        _together(texts, group, length, out)
    return out


def _together(texts: list[np.ndarray], group: list[int], length: int, out: list[tuple[np.ndarray, ...]]) -> None:
    """Sets ``out`` of the texts of a group, none of them shorter than ``length``."""
    size = np.fromiter((len(texts[i]) for i in group), np.int64, len(group))
    base = np.cumsum(size) - size
    prefix, h, place = _minima(np.concatenate([texts[i] for i in group]), length)
    crossing = np.zeros(len(place), bool)  # windows that begin in one text and end in the next
    for end in (base[1:]).tolist():
        crossing[end - length + 1 : end] = True
    # windows of two texts have no anchor in common, so a segment never goes on into the next text
    inside = np.flatnonzero(~crossing)
    place = place[inside]
    new = np.flatnonzero(np.diff(place, prepend=-1))
    start, count, place = inside[new], np.diff(new, append=len(inside)), place[new]
    whole = common.span_hash(prefix, start, start + count + length - 1)
    anchor, segment = h[place], common.mix64(whole + count.astype(np.uint64))
    bounds = np.append(np.searchsorted(start, base), len(start)).tolist()
    for i, at, a, b in zip(group, base.tolist(), bounds[:-1], bounds[1:], strict=True):
        out[i] = (anchor[a:b], segment[a:b], start[a:b] - at, count[a:b], place[a:b] - start[a:b])


ROWS = "task int, row long, text binary, anchor array<long>, segment array<long>, windows array<int>, inside array<int>"


def _cut(length: int):
    """The columns before ``text``, and ROWS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        serial = 0
        # a few rows at a time: their hashes take several times the room of the texts
        for batch in (b.slice(at, AT_ONCE) for b in batches for at in range(0, b.num_rows, AT_ONCE)):
            texts = [common.as_bytes(value if value.is_valid else None) for value in batch.column(batch.num_columns - 1)]
            found = segments_of(texts, length)
            ends = np.cumsum([0, *(len(x[0]) for x in found)]).astype(np.int32)
            listed = [
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, t), *(x[c] for x in found)]).astype(t, copy=False).view(to)))
                for c, t, to in ((0, np.uint64, np.int64), (1, np.uint64, np.int64), (3, np.int32, np.int32), (4, np.int32, np.int32))
            ]
            n = batch.num_rows
            rows = np.arange(serial, serial + n) + (task << 33)
            serial += n
            names = [f.name for f in batch.schema][:-1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.full(n, task, np.int32)), pa.array(rows), pa.array([x.tobytes() for x in texts], pa.binary()), *listed],
                [*names, "task", "row", "text", "anchor", "segment", "windows", "inside"],
            )

    return run


def _started(batch: pa.RecordBatch, i: int, first: int) -> list[list[int]]:
    """anchor, segment, start, windows, inside of a text's segments; ``first``: the column of anchors."""
    anchor, segment, windows, inside = (np.asarray(batch.column(first + k)[i].values) for k in range(4))
    return [x.tolist() for x in (anchor, segment, np.cumsum(windows) - windows, windows, inside)]


# --- column-wise construction -------------------------------------------------------------------------


def repeats(data: np.ndarray, base: np.ndarray, size: np.ndarray, zero: np.ndarray, group: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings of a collection have a suffix whose first ``length`` symbols another one shares.

    String i is ``data[base[i] : base[i] + size[i]]``; its symbol number ``zero[i]`` stands in column 0, and
    only strings of one group are compared.  Gives (string, symbol number) of each repeated suffix."""
    right, left = size - zero - 1, -zero  # last and first column
    enter, leave = np.argsort(-right, kind="stable"), left
    n_entered = 0
    order = np.zeros(0, np.int64)  # strings, by group, then by suffix
    common_prefix = np.zeros(0, np.int64)  # with the one before; 0 where a group begins
    strings, columns = [], []
    oldest = int(left.max()) if len(left) else 0
    for column in range(int(right.max()) if len(right) else -1, (int(left.min()) if len(left) else 0) - 1, -1):
        if column < oldest and len(order):  # strings that have begun further right are complete
            stays = leave[order] <= column
            if not stays.all():
                kept = np.flatnonzero(stays)
                if len(kept):
                    # the prefix shared across the gone ones is the least of theirs
                    common_prefix = np.minimum.reduceat(common_prefix[: kept[-1] + 1], np.concatenate([[0], kept[:-1] + 1]))
                order, common_prefix = order[kept], common_prefix[: len(kept)]
        upto = n_entered
        while upto < len(enter) and right[enter[upto]] == column:
            upto += 1
        if upto > n_entered:  # an empty suffix comes before all others of its group
            new = enter[n_entered:upto]
            n_entered = upto
            everyone = np.concatenate([new, order])
            by_group = np.argsort(group[everyone], kind="stable")
            common_prefix = np.concatenate([np.zeros(len(new), np.int64), common_prefix])[by_group]
            order = everyone[by_group]
        if not len(order):
            continue
        # one symbol of each string: this round's stretch of the transform
        symbol = data[base[order] + zero[order] + column]
        key = group[order] * 256 + symbol
        to = np.argsort(key, kind="stable")
        key = key[to]
        same = np.zeros(len(to), bool)
        same[1:] = key[1:] == key[:-1]
        longer = np.zeros(len(to), np.int64)
        next_to = same.copy()
        next_to[1:] &= to[1:] == to[:-1] + 1
        longer[next_to] = common_prefix[to[next_to]] + 1
        apart = np.flatnonzero(same & ~next_to)
        if len(apart):  # least over (former place of the one before, own former place]
            padded = np.append(common_prefix, 0)
            ends = np.stack([to[apart - 1] + 1, to[apart] + 1], 1).ravel()
            longer[apart] = np.minimum.reduceat(padded, ends)[::2] + 1
        order, common_prefix = order[to], longer
        hit = common_prefix >= length
        if hit.any():
            hit[:-1] |= hit[1:]
            found = order[hit]
            strings.append(found)
            columns.append(zero[found] + column)
    if not strings:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(strings), np.concatenate(columns)


def runs(strings: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first, last) of the runs of consecutive places."""
    order = np.lexsort((places, strings))
    s, p = strings[order], places[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s))[: len(first)] - 1
    return s[first], p[first], p[last]


def _construct(length: int):
    """Collections of whole partitions: anchor, segment, from, to of each run of repeated window starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        anchor, segment, part, shift, inside = (table.column(c).to_numpy() for c in ("anchor", "segment", "part", "shift", "inside"))
        blobs = table.column("bytes").to_pylist()
        size = np.fromiter(map(len, blobs), np.int64, len(blobs))
        data = np.frombuffer(b"".join(blobs), np.uint8)
        del blobs, held
        base = np.cumsum(size) - size
        key = common.mix64(anchor.view(np.uint64) * np.uint64(3) + part.view(np.uint64))
        group = np.unique(key, return_inverse=True)[1].astype(np.int64)
        strings, places = repeats(data, base, size, inside.astype(np.int64), group, length)
        s, a, b = runs(strings, places)
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor[s]), pa.array(segment[s]), pa.array((a + shift[s]).astype(np.int32)), pa.array((b + shift[s]).astype(np.int32))], ["anchor", "segment", "from", "to"]
        )

    return run


def _key(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def _fetch(length: int):
    """The wanted pieces of each text, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for i in range(batch.num_rows):
                data = batch.column(0)[i].as_buffer().to_pybytes()
                wanted: dict[int, list] = {}
                for w in batch.column(5)[i].as_py():
                    wanted.setdefault(w["segment"], []).append(w)
                for h, s, at, n, place in zip(*_started(batch, i, 1), strict=True):
                    for w in wanted.get(s, ()):
                        if w["copies"] < 1:
                            continue
                        w["copies"] -= 1
                        a, b = w["from"], min(n, w["to"])
                        for c, x in zip(out, (h, s, w["part"], a, place - a, data[at + a : at + b + length - 1]), strict=True):
                            c.append(x)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["anchor", "segment", "part", "shift", "inside", "bytes"])

    return run


def _bands(length: int, width: int):
    """The wanted pieces cut into bands of ``width`` columns: key of what the windows of a band share, hash of the piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for i in range(batch.num_rows):
                data, row = batch.column(0)[i].as_buffer().to_pybytes(), batch.column(6)[i].as_py()
                wanted: dict[int, list] = {}
                for w in batch.column(5)[i].as_py():
                    wanted.setdefault(w["segment"], []).append(w)
                for h, s, at, n, place in zip(*_started(batch, i, 1), strict=True):
                    for w in wanted.pop(s, ()):
                        a, stop = w["from"], min(n, w["to"])
                        while a < stop:
                            band = (a - place) // width
                            b = min(stop, place + (band + 1) * width)
                            low = at + place + band * width  # where the band's first window begins
                            part = _key(band.to_bytes(8, "little", signed=True), data[low + width - 1 : low + length])
                            piece = _key((a - place).to_bytes(8, "little", signed=True), data[at + a : at + b + length - 1])
                            for c, x in zip(out, (h, s, row, a, b, part, piece, w["n"]), strict=True):
                                c.append(x)
                            a = b
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["anchor", "segment", "row", "from", "to", "part", "piece", "n"])

    return run


BANDS = "anchor long, segment long, row long, from int, to int, part long, piece long, n long"


# --- the operator -----------------------------------------------------------------------------------


def covered(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open ranges, in order."""
    out: list[list[int]] = []
    for a, b in sorted(zip(start.tolist(), stop.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


SPANS = "array<struct<start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _spans(length: int):
    """task, row, spans: the bytes covered by the ranges of repeated windows in a text's segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for i in range(batch.num_rows):
                ranges: dict[int, list[tuple[int, int]]] = {}
                for x in batch.column(6)[i].as_py():
                    ranges.setdefault(x["segment"], []).append((x["from"], x["to"]))
                a, b = [], []
                for _, s, at, n, _ in zip(*_started(batch, i, 2), strict=True):
                    for f, t in ranges.get(s, ()):
                        a.append(at + f)
                        b.append(at + min(t, n - 1) + length)
                spans.append([{"start": x, "end": y} for x, y in covered(np.asarray(a, np.int64), np.asarray(b, np.int64))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, _SPANS)], ["task", "row", "spans"])

    return run


def _runs(length: int):
    """(task, row, text, spans) to the runs of ``length`` bytes or more: outer_task, outer_row, at, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for task, row, text, spans in zip(*batch.columns, strict=True):
                data = text.as_buffer().to_pybytes()
                for x in spans.as_py():
                    if x["end"] - x["start"] >= length:
                        for c, v in zip(out, (task.as_py(), row.as_py(), x["start"], data[x["start"] : x["end"]]), strict=True):
                            c.append(v)
            types = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["outer_task", "outer_row", "at", "text"])

    return run


def without(data: bytes, spans: list[dict]) -> bytes:
    rest, at = [], 0
    for x in spans:
        rest.append(data[at : x["start"]])
        at = x["end"]
    return b"".join([*rest, data[at:]])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) to doc_id, n_bytes, spans, kept."""
    for batch in batches:
        spans = [x.as_py() or [] for x in batch.column(2)]
        data = [x.as_buffer().to_pybytes() for x in batch.column(1)]
        kept = [without(d, x) for d, x in zip(data, spans, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, data)), pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_words long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans, passages) to doc_id and DIGEST."""
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for text, spans, runs_ in zip(*batch.columns[1:], strict=True):
            data, gone = text.as_buffer().to_pybytes(), spans.as_py() or []
            kept = without(data, gone)
            words = [len(data[x["start"] : x["end"]].split()) for x in runs_.as_py() or []]
            words = [w for w in words if w > PASSAGE_WORDS]
            for c, v in zip(out, (len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), len(words), sum(words)), strict=True):
                c.append(v)
        types = (*[pa.int64()] * 3, pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], ["doc_id", *(f.split()[0] for f in DIGEST.split(", "))])


@contextmanager
def _met_by_task(spark: SparkSession):
    """Joins on task and row take the buckets by task as they are; the setting goes back afterwards."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Texts:
    """A table of texts cut into segments of windows of ``length``, bucketed by task, and what repeats in it."""

    def __init__(self, source: DataFrame, length: int, work: common.Workspace, buckets: int = 0) -> None:
        """source: any columns, then ``text``."""
        self.spark, self.length, self.work = source.sparkSession, length, work
        self.name = f"suffix_{uuid.uuid4().hex}"
        work.tables.append(self.name)
        cut = source.mapInArrow(_cut(length), common.extended(source.drop("text"), ROWS))
        # fewer buckets than shuffle partitions would make Spark shuffle the texts after all
        self.buckets = buckets or max(1, min(MAX_BUCKETS, max(source.rdd.getNumPartitions(), int(self.spark.conf.get("spark.sql.shuffle.partitions")))))
        # every task writes one value of ``task``, so one file; the joins below find it where it is
        cut.write.bucketBy(self.buckets, "task").option("compression", "zstd").option("path", f"{work.path}/{self.name}").saveAsTable(self.name)
        self.table = self.spark.table(self.name)

    def _with(self, wants: DataFrame, *columns: str) -> DataFrame:
        """Texts with the list of what is wanted of each.  wants: row, and columns."""
        listed = wants.groupBy(F.shiftright("row", 33).cast("int").alias("task"), "row").agg(F.collect_list(F.struct(*columns)).alias("want"))
        return self.table.join(listed, ["task", "row"]).select("text", "anchor", "segment", "windows", "inside", "want", "row")

    def spans(self) -> DataFrame:
        """task, row, spans of the texts that hold strings of ``length`` bytes which start elsewhere, too."""
        work, span = self.work, self.length - min(ANCHOR, self.length) + 1
        every = self.table.select("row", F.explode(F.arrays_zip("anchor", "segment")).alias("x")).select("row", "x.anchor", "x.segment")
        groups = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("of")).where(F.col("of") > 1)
        groups = work.write(groups.select("anchor"), "suffix-anchors")  # so that both sides of the join are plain shuffles, which Spark splits where skewed
        members = work.write(every.join(groups, "anchor"), "suffix-members")
        distinct = members.groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"), F.max("row").alias("last"))
        kinds = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
        known = work.write(distinct.join(kinds, "anchor"), "suffix-known")

        # of every segment one text, of those that repeat two (or one text that has it twice)
        piece = lambda row, copies: (row, "anchor", "segment", F.lit(0).alias("part"), F.lit(0).alias("from"), F.lit(PIECE).alias("to"), copies.alias("copies"))
        cold = known.where(F.col("kinds") <= HOT)
        wants = cold.select(*piece(F.col("row"), F.when((F.col("n") > 1) & (F.col("row") == F.col("last")), 2).otherwise(1)))
        wants = wants.union(cold.where(F.col("last") != F.col("row")).select(*piece(F.col("last").alias("row"), F.lit(1))))
        hot = known.where(F.col("kinds") > HOT).select("row", "segment", "n", F.lit(0).alias("from"), F.lit(PIECE).alias("to"))
        ranges, width = [], (span + 1) // 2
        while not hot.isEmpty():
            banded = work.write(self._with(hot, "segment", "from", "to", "n").mapInArrow(_bands(self.length, width), BANDS), "suffix-bands")
            pieces = banded.groupBy("anchor", "part", "piece").agg(F.sum("n").alias("c"), F.min(F.struct("row", "segment", "from", "to")).alias("rep"))
            parts = pieces.groupBy("anchor", "part").agg(F.count(F.lit(1)).alias("kinds"))
            pieces = work.write(pieces.join(parts, ["anchor", "part"]), "suffix-pieces")
            equal = banded.join(pieces.where("c > 1").select("anchor", "part", "piece"), ["anchor", "part", "piece"])
            ranges.append(work.write(equal.select("anchor", "segment", "from", (F.col("to") - 1).alias("to")), "suffix-equal"))
            others = pieces.where("kinds > 1").select("rep.row", "anchor", "rep.segment", "part", "rep.from", "rep.to", "c", "kinds")
            wants = wants.union(others.where(F.col("kinds") <= HOT).select("row", "anchor", "segment", "part", "from", "to", F.lit(1)))
            # one column: all pieces of a part are one string, so nothing is left
            hot = others.where(F.col("kinds") > HOT).select("row", "segment", F.col("c").alias("n"), "from", "to")
            width = max(1, -(-width // FINER))

        wants = work.write(wants, "suffix-wants")
        volume = wants.count() * (self.length + 150)
        tasks = max(self.spark.sparkContext.defaultParallelism, volume // COLLECTION + 1)
        fetched = self._with(wants, "segment", "part", "from", "to", "copies").mapInArrow(_fetch(self.length), "anchor long, segment long, part long, shift int, inside int, bytes binary")
        found = fetched.repartition(tasks, "anchor", "part").mapInArrow(_construct(self.length), "anchor long, segment long, from int, to int")
        ranges = [work.write(found.distinct(), "suffix-ranges"), *ranges]
        for more in ranges[1:]:
            ranges[0] = ranges[0].union(more)
        packed = ranges[0].groupBy("anchor", "segment").agg(F.collect_set(F.struct("from", "to")).alias("ranges"))
        hits = members.join(packed, ["anchor", "segment"]).select("row", "segment", F.explode("ranges").alias("r"))
        texts = self._with(hits.select("row", "segment", "r.from", "r.to").distinct(), "segment", "from", "to")
        texts = texts.select(F.shiftright("row", 33).cast("int").alias("task"), "row", "anchor", "segment", "windows", "inside", "want")
        return work.write(texts.mapInArrow(_spans(self.length), f"task int, row long, spans {SPANS}"), "suffix-spans")


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges, array of start and end), kept (the bytes that stay)."""
    spark = docs.sparkSession
    with common.Workspace(spark, "suffix") as work, _met_by_task(spark):
        texts = Texts(docs.select("doc_id", "text"), length, work)
        joined = texts.table.join(texts.spans(), ["task", "row"], "left").select("doc_id", "text", "spans")
        found = joined.mapInArrow(_kept, common.extended(joined.select("doc_id"), f"n_bytes long, spans {SPANS}, kept binary"))
        found = common.materialise(found, "suffix-kept")
    return found


def report(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; and of the passages that repeat, n_passages and passage_words."""
    spark = docs.sparkSession
    passage = min(passage, length)
    with common.Workspace(spark, "suffix") as work, _met_by_task(spark):
        texts = Texts(docs.select("doc_id", "text"), passage, work)
        passages = texts.spans()
        runs_ = texts.table.select("task", "row", "text").join(passages, ["task", "row"]).mapInArrow(_runs(length), "outer_task int, outer_row long, at long, text binary")
        inner = Texts(runs_, length, work, texts.buckets)
        within = inner.table.select("task", "row", "outer_row", "at").join(inner.spans(), ["task", "row"]).select("outer_row", "at", F.explode("spans").alias("x"))
        span = F.struct((F.col("at") + F.col("x.start")).alias("start"), (F.col("at") + F.col("x.end")).alias("end"))
        removed = within.groupBy(F.shiftright("outer_row", 33).cast("int").alias("task"), F.col("outer_row").alias("row")).agg(F.array_sort(F.collect_list(span)).alias("removed"))
        removed = work.write(removed, "suffix-removed")
        joined = texts.table.join(removed, ["task", "row"], "left").join(passages, ["task", "row"], "left").select("doc_id", "text", "removed", "spans")
        found = common.materialise(joined.mapInArrow(_digest, common.extended(joined.select("doc_id"), DIGEST)), "suffix-report")
    return found


def brute(texts: list[bytes], length: int = LENGTH) -> list[dict[str, object]]:
    """The same by counting every window (for tests)."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[: len(t)]
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        out.append({"n_bytes": len(t), "n_removed": int(gone.sum()), "n_spans": int((edges == 1).sum()), "kept_sha256": hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()})
    return out
