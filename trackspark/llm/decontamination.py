"""Operator 4: benchmark decontamination with one Aho-Corasick automaton.

Benchmark items are cut into windows of ``WINDOW`` normalised words (an item of fewer words is one
window).  One automaton over all distinct windows scans each document once; the end of a match in the
normalised text is mapped to its words and, for spans, back to character offsets of the original.

The automaton is built from the benchmark alone, a stated query set.  Its size is checked: up to
``BLOCK_WINDOWS`` windows (a few hundred bytes each) go into one broadcast automaton; a larger
benchmark is cut into blocks of that many.  The documents are scanned once per block; what a block hits is
written and its automaton released before the next one is built, and the hit words are united per document,
from which counts and spans follow as they do with one automaton.

Normalised: A-Z lower-cased, words are runs of 0-9, a-z and everything beyond ASCII.

Cases: null or wordless documents have no words, no hits; null or wordless items have no window and
never count; equal items all count; an empty benchmark hits nothing; repeated documents are separate
rows; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 13
BLOCK_WINDOWS = 200_000

_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Bytes to bytes: A-Z to a-z, everything between words to a space.  UTF-8 beyond ASCII is kept.
NORMAL = bytes((b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20) for b in range(256))

RESULT = pa.schema([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])
RESULT_DDL = "n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:long,end:long>>"


def words(text: str | bytes | None) -> list[bytes]:
    if text is None:
        return []
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else bytes(text)
    return data.translate(NORMAL).split()


def windows(benchmark: DataFrame) -> DataFrame:
    """item_id string, _op_text: each item's windows as space-joined words."""
    # the regular expression works on characters; all characters beyond ASCII belong to words
    lower = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    return (
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), found.alias("_op_words"))
        .where(F.size("_op_words") > 0)
        .withColumn("_op_start", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_op_words") - WINDOW + 1))))
        .select("item_id", F.array_join(F.slice("_op_words", F.col("_op_start"), F.lit(WINDOW)), " ").alias("_op_text"))
        .distinct()
    )


def build(rows: list[tuple[str, list[str]]]) -> ahocorasick.Automaton:
    """An automaton over (window, its items).  Windows are set between spaces, so that only whole words match."""
    machine = ahocorasick.Automaton()
    for text, items in rows:
        machine.add_word(f" {text} ".encode().decode("latin-1"), (text.count(" ") + 1, len(text.encode()) + 2, tuple(items)))
    machine.make_automaton()
    return machine


def scan(machine, text) -> tuple[int, np.ndarray, set[str]]:
    """Number of words, a flag per word for being hit, the items found."""
    found = words(text)
    hit = np.zeros(len(found), bool)
    items: set[str] = set()
    if not found or not len(machine):
        return len(found), hit, items
    line = b" " + b" ".join(found) + b" "
    first_word: dict[int, int] | None = None
    for end, (n, length, owners) in machine.iter(line.decode("latin-1")):
        if first_word is None:  # where each word starts in the line
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            first_word = {int(s): i for i, s in enumerate(np.concatenate([[1], 1 + np.cumsum(lengths + 1)[:-1]]))}
        at = first_word[end - length + 2]
        hit[at : at + n] = True
        items.update(owners)
    return len(found), hit, items


def spans(text: str | None, hit: np.ndarray) -> list[dict[str, int]]:
    """Character offsets, in the original, of the runs of hit words."""
    if not hit.any():
        return []
    data = text.encode("utf-8", "surrogatepass")
    inside = np.concatenate([[False], np.frombuffer(data.translate(NORMAL), np.uint8) != 0x20, [False]])
    edge = np.diff(inside.astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    char = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    runs = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [{"start": int(char[start[a]] - 1), "end": int(char[end[b - 1] - 1])} for a, b in zip(np.flatnonzero(runs == 1), np.flatnonzero(runs == -1), strict=True)]


def _scanner(machine, with_text: bool):
    """The columns beside ``text`` (and it, too, if wanted), then RESULT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine.get()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            found = [scan(own, value.as_buffer().to_pybytes() if value.is_valid else None) for value in texts]
            yield _with_result(batch, ["text"] * (not with_text), [(n, hit, items, texts[i]) for i, (n, hit, items) in enumerate(found)])

    return run


def _with_result(batch: pa.RecordBatch, without: list[str], found: list[tuple]) -> pa.RecordBatch:
    """RESULT after the columns of a batch; found: number of words, flags of hit words, items, text of each row."""
    rows = [(n, int(hit.sum()), len(items), sorted(items), spans(text.as_py(), hit) if items else []) for n, hit, items, text in found]
    keep = [i for i, name in enumerate(batch.schema.names) if name not in without]
    arrays = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(RESULT)]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *arrays], [*(batch.schema.names[i] for i in keep), *(f"_op_{n}" for n in RESULT.names)])


def _added(kept: list[T.StructField]) -> T.StructType:
    return T.StructType(kept + [T.StructField(f"_op_{f.name}", f.dataType) for f in T.StructType.fromDDL(RESULT_DDL)])


def _automaton(part: DataFrame) -> common.Shipped:
    return common.Shipped(part.sparkSession, build([(r[0], r[1]) for r in part.select("_op_text", "items").collect()]))  # at most BLOCK_WINDOWS


def decontaminate(docs: DataFrame, benchmark: DataFrame, with_text: bool = False) -> DataFrame:
    """The columns of ``docs`` (without text unless ``with_text``) and ``decon``: a struct of
    n_words, n_hit, n_items, items (sorted item ids) and spans (character offsets of hit runs in the original)."""
    rows = windows(benchmark).groupBy("_op_text").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    n = rows.count()
    docs = docs.drop("decon")
    kept = [f for f in docs.schema.fields if f.name != "text" or with_text]
    if n <= BLOCK_WINDOWS:
        found = docs.mapInArrow(_scanner(_automaton(rows), with_text), _added(kept))
    else:
        found = _in_blocks(docs, rows, n, kept)
    return found.select(*[F.col(f"`{f.name}`") for f in kept], F.struct(*[F.col(f"_op_{f.name}").alias(f.name) for f in RESULT]).alias("decon"))


def _hits(machine):
    """_op_block_row, the items and the numbers of the words that are hit, of documents that are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine.get()
        for batch in batches:
            out = []
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, hit, items = scan(own, value.as_buffer().to_pybytes() if value.is_valid else None)
                if items:
                    out.append((row, sorted(items), np.flatnonzero(hit).tolist()))
            columns = list(zip(*out, strict=True)) or [[], [], []]
            types = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["_op_block_row", "_op_block_items", "_op_block_hit"])

    return run


def _unite(names: list[str]):
    """From a document and the hits of all blocks, what one automaton would have given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, listed, numbers = (batch.column(batch.schema.get_field_index(c)) for c in ("text", "_op_block_items", "_op_block_hit"))
            found = []
            for text, items, at in zip(texts, listed.to_pylist(), numbers.to_pylist(), strict=True):
                hit = np.zeros(len(words(text.as_py())), bool)
                hit[np.array(at or [], np.int64)] = True
                found.append((len(hit), hit, items or [], text))
            yield _with_result(batch, [c for c in batch.schema.names if c not in names], found)

    return run


def _in_blocks(docs: DataFrame, rows: DataFrame, n: int, kept: list[T.StructField]) -> DataFrame:
    """Scan block after block of the benchmark and unite each document's hits.

    Documents get a row number of their own on shared storage, as ids may repeat."""
    spark = docs.sparkSession
    with common.Workspace(spark, "decon") as work:
        docs = work.write(docs.withColumn("_op_block_row", F.monotonically_increasing_id()), "docs")
        blocks = 2 * -(-n // BLOCK_WINDOWS)  # dealt by hash, half full: none gets over the bound
        numbered = work.write(rows.withColumn("_op_block", F.pmod(F.xxhash64("_op_text"), F.lit(blocks))), "windows")
        hits = None
        for b in range(blocks):
            machine = _automaton(numbered.where(F.col("_op_block") == b))
            found = docs.select("_op_block_row", "text").mapInArrow(_hits(machine), "_op_block_row long, _op_block_items array<string>, _op_block_hit array<long>")
            part = work.write(found, "hits")
            machine.data.destroy()
            hits = part if hits is None else hits.unionByName(part)
        listed = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("_op_block_items", "_op_block_hit")]
        joined = docs.join(hits.groupBy("_op_block_row").agg(*listed), "_op_block_row", "left")
        return common.materialise(joined.mapInArrow(_unite([f.name for f in kept]), _added(kept)), "decon")


def contaminated() -> F.Column:
    """At least a twentieth of a document's words are hit."""
    return (F.col("decon.n_hit") > 0) & (F.col("decon.n_hit") * 20 >= F.col("decon.n_words"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (``start-end`` of each hit run, comma-joined)."""
    listed = F.transform("decon.spans", lambda s: F.concat_ws("-", s["start"], s["end"]))
    return decontaminate(docs.select("doc_id", "text"), benchmark).select(
        "doc_id", "decon.n_words", "decon.n_hit", "decon.n_items",
        F.sha2(F.array_join("decon.items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"), F.array_join(listed, ",").alias("spans"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    columns = docs.columns
    return decontaminate(docs, benchmark, with_text=True).where(~contaminated()).select(*[F.col(f"`{c}`") for c in columns])


def brute(text: str | None, items: list[tuple[object, str | None]]) -> dict[str, object]:
    """The same by comparing every window with every place (for tests)."""
    doc, hit, found = words(text), set(), set()
    for item_id, item in items:
        w = words(item)
        size = min(WINDOW, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            for j in range(len(doc) - size + 1):
                if doc[j : j + size] == w[i : i + size]:
                    hit.update(range(j, j + size))
                    found.add(str(item_id))
    return {"n_words": len(doc), "n_hit": len(hit), "n_items": len(found), "items_sha256": hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), "contaminated": len(hit) > 0 and 20 * len(hit) >= len(doc)}


#: Another engine's SQL: documents and items as word lists, windows matched by equality of joined words.
SQL = r"""
with _b as (select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
_win as (select distinct item_id, least({window}, len(w)) as size, array_to_string(w[i:i + least({window}, len(w)) - 1], ' ') as t from (select *, unnest(range(1, greatest(1, len(w) - {window} + 1) + 1)) as i from _b where len(w) > 0)),
_d as (select row_number() over () as rid, doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from {docs}),
_sizes as (select distinct size from _win),
_at as (select rid, size, i, array_to_string(w[i:i + size - 1], ' ') as t from (select rid, w, size, unnest(range(1, len(w) - size + 2)) as i from _d, _sizes)),
_hits as (select a.rid, a.i, a.size, v.item_id from _at a join _win v on a.size = v.size and a.t = v.t),
_words as (select rid, count(distinct k) as n_hit from (select rid, unnest(range(i, i + size)) as k from _hits) group by rid),
_k as (select distinct rid, k from (select rid, unnest(range(i, i + size)) as k from _hits)),
_cut as (select rid, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x60\x7B-\x7F]+') as parts from _d where rid in (select rid from _k)),
_part as (select rid, unnest(parts) as p, unnest(range(1, len(parts) + 1)) as place from _cut),
_off as (select rid, p, place, sum(length(p)) over (partition by rid order by place) as till, regexp_matches(p, '^[^\x00-\x2F\x3A-\x60\x7B-\x7F]') as word from _part),
_pos as (select rid, row_number() over (partition by rid order by place) as k, till - length(p) as a, till as b from _off where word),
_run as (select rid, a, b, k - row_number() over (partition by rid order by k) as g from _pos join _k using (rid, k)),
_spans as (select rid, string_agg(a || '-' || b, ',' order by a) as spans from (select rid, g, cast(min(a) as bigint) as a, cast(max(b) as bigint) as b from _run group by rid, g) group by rid),
_items as (select rid, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct rid, item_id from _hits) group by rid)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(x.n_items, 0) as n_items, sha256(coalesce(x.items, '')) as items_sha256,
  coalesce(h.n_hit, 0) > 0 and 20 * coalesce(h.n_hit, 0) >= len(d.w) as contaminated,
  coalesce(s.spans, '') as spans
from _d d left join _words h on d.rid = h.rid left join _items x on d.rid = x.rid left join _spans s on d.rid = s.rid
"""


def sql(docs: str = "documents") -> str:
    return SQL.format(docs=docs, window=WINDOW)
