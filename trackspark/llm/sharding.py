"""Operator 7: sharding through fixed virtual slots (DataFrame functions only).

Records are hashed into ``SLOTS`` virtual slots, a number that never changes.  Bytes are summed per
slot, and a small versioned table maps slots to shards.  To rebalance or to add shards the table is
edited: slots stay where they are while their shard keeps within the tolerance, the rest move to the
least loaded shard.  The law is ``bytes``: shards end up with near equal bytes.

Only the slot table (``SLOTS`` rows, a constant) is ever in one task or broadcast.  A record's place in
its shard is its place in its slot plus the rows of the shard's earlier slots, so no task sees a whole
shard.  Records hash by id and text together, so a repeated id alone fills no slot.  Equal rows are counted
before they are shuffled and dealt in turn to the slots after their own, so however many there are, each slot
gets at most one more of them than another.

Cases: null ids and texts hash as empty, a null text has no bytes; equal rows lie in slots next to each other;
an empty table gives an empty result and a map of empty slots; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SLOTS = 4096
SHARDS = 24
#: Bytes that a record takes besides its text.
OVERHEAD = 8
#: A slot may stay in its shard up to this much over the mean.
TOLERANCE = 0.02


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, _op_key (hash of the record), vslot, copies (equal rows in this slot)."""
    text = F.col("text").cast("binary")
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("").cast("binary")))).cast("binary"))
    records = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("").cast("binary"))).alias("text_crc32"),
        key.alias("_op_key"),
    )
    equal = records.groupBy("doc_id", "size", "text_crc32", "_op_key").agg(F.count(F.lit(1)).alias("_op_n"))
    turns = F.explode(F.sequence(F.lit(0), F.least(F.col("_op_n"), F.lit(slots)).cast("int") - 1))  # at most one a slot
    own = F.conv(F.substring("_op_key", 1, 8), 16, 10).cast("long")
    copies = F.floor(F.col("_op_n") / slots) + (F.col("_op_turn") < F.col("_op_n") % slots).cast("long")
    return equal.withColumn("_op_turn", turns).select(
        "doc_id", "size", "text_crc32", "_op_key", ((own + F.col("_op_turn")) % slots).cast("int").alias("vslot"), copies.alias("copies")
    )


def slot_sizes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """vslot, bytes, n for each of the slots, empty ones too."""
    used = records.groupBy("vslot").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("n"))
    every = records.sparkSession.range(slots, numPartitions=1).select(F.col("id").cast("int").alias("vslot"))
    return every.join(used, "vslot", "left").fillna(0, ["bytes", "n"])


def assign(sizes: DataFrame, shards: int = SHARDS, old: DataFrame | None = None, version: int = 1, tolerance: float = TOLERANCE) -> DataFrame:
    """A slot-to-shard map: version, vslot, shard, bytes, n, first (rows of the shard before the slot).

    Slots go heaviest first: back to their old shard if ``old`` (a map) has one that stays within the
    tolerance, else to the shard with the fewest bytes so far, the lowest number first."""
    sizes = sizes.withColumn("was", F.lit(-1)) if old is None else sizes.join(F.broadcast(old.select("vslot", F.col("shard").alias("was"))), "vslot", "left").fillna(-1, ["was"])
    limit = F.col("_op_total") / F.lit(float(shards)) * (1 + tolerance)

    def place(acc: Column, slot: Column) -> Column:
        loads = acc["loads"]
        stays = (slot["was"] >= 0) & (slot["was"] < shards) & (F.get(loads, slot["was"]) + slot["bytes"] <= limit)
        to = F.when(stays, slot["was"]).otherwise((F.array_position(loads, F.array_min(loads)) - 1).cast("int"))
        moved = F.struct(slot["vslot"].alias("vslot"), to.alias("shard"), slot["bytes"].alias("bytes"), slot["n"].alias("n"))
        return F.struct(
            F.transform(loads, lambda x, i: F.when(i == to, x + slot["bytes"]).otherwise(x)).alias("loads"),
            F.concat(acc["map"], F.array(moved)).alias("map"),
        )

    packed = sizes.agg(
        F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("order"), "vslot", "bytes", "n", "was"))).alias("_op_slots"),
        F.sum("bytes").alias("_op_total"),
    )
    none = F.array().cast("array<struct<vslot:int,shard:int,bytes:bigint,n:bigint>>")
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), none.alias("map"))
    placed = packed.select(F.explode(F.aggregate("_op_slots", start, place, lambda acc: acc["map"])).alias("m")).select("m.*")
    earlier = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("version", F.lit(version))


def save_map(shard_map: DataFrame, path: str) -> None:
    """Add a version to the stored map (one Parquet folder per version)."""
    shard_map.coalesce(1).write.partitionBy("version").mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the newest one by default."""
    stored = spark.read.parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version)


def rebalance(records: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """Edit the newest stored map for what the slots weigh now, store it as the next version, return it."""
    spark = records.sparkSession
    newest = load_map(spark, path)
    version = newest.select(F.max("version")).first()[0] + 1
    save_map(assign(slot_sizes(records), shards, newest, version), path)
    return load_map(spark, path, version)


def shard(docs: DataFrame, shards: int = SHARDS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place in the shard, from 0), grown_shard, vslot, map_version.

    ``path``: where the map is stored; a new place on shared storage by default."""
    spark = docs.sparkSession
    records = common.materialise(slotted(docs), "slotted")  # texts are read once, not again for the places
    path = path or common.scratch(spark, "slot-map")
    save_map(assign(slot_sizes(records), shards), path)
    current = load_map(spark, path)
    before = Window.partitionBy("vslot").orderBy("_op_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return (
        records.withColumn("_op_before", F.coalesce(F.sum("copies").over(before), F.lit(0)))
        .withColumn("_op_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .withColumn("_op_place", F.col("_op_before") + F.col("_op_copy"))
        .join(F.broadcast(current.select("vslot", "shard", "first", "version")), "vslot")
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("first") + F.col("_op_place")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "vslot", F.col("version").cast("int").alias("map_version"),
        )
    )


#: Another engine's SQL: the slots are dealt in a recursion, crc32 is folded over the bytes.
SQL = """
with recursive
_crc(i, c, k) as (select i, i, 0 from range(256) t(i) union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from _crc where k < 8),
_table as (select list(c order by i) as t from _crc where k = 8),
_in as (select doc_id, text, coalesce(octet_length(encode(text)), 0) + 8 as size, md5(concat_ws('|', coalesce(cast(doc_id as varchar), ''), md5(coalesce(text, '')))) as k from {docs}),
_rec as (select doc_id, text, size, k, (cast(('0x' || substr(k, 1, 8)) as bigint) + row_number() over (partition by k, doc_id) - 1) % {slots} as vslot from _in),
_sizes as (select s.vslot, coalesce(sum(size), 0) as bytes, count(r.vslot) as n from range({slots}) s(vslot) left join _rec r on r.vslot = s.vslot group by s.vslot),
_order as (select *, row_number() over (order by bytes desc, vslot) as r from _sizes),
_deal(r, shard, loads) as (
  select 0::bigint, 0::bigint, list_transform(range({shards}), lambda x: 0::hugeint)
  union all
  select r, shard, list_concat(loads[:shard], [loads[shard + 1] + bytes], loads[shard + 2:])
  from (select o.r, o.bytes, d.loads, list_position(d.loads, list_min(d.loads)) - 1 as shard from _deal d join _order o on o.r = d.r + 1)),
_map as (select o.vslot, o.n, d.shard, coalesce(sum(o.n) over (partition by d.shard order by o.vslot rows between unbounded preceding and 1 preceding), 0) as first
  from _order o join _deal d on o.r = d.r),
_placed as (select r.*, m.shard, m.first + row_number() over (partition by r.vslot order by r.k, r.doc_id nulls first) - 1 as slot from _rec r join _map m on r.vslot = m.vslot),
_crcs as (select text, xor(list_reduce(list_transform(range(1, octet_length(encode(text)) + 1), lambda i: cast(('0x' || substr(h, 2 * i - 1, 2)) as bigint)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295) as crc
  from (select text, hex(encode(text)) as h from (select distinct text from _rec where text <> '')), _table)
select p.doc_id, cast(p.size as bigint) as size, cast(coalesce(c.crc, 0) as bigint) as text_crc32, 'bytes' as law, cast(p.shard as integer) as shard,
  cast(p.slot as bigint) as slot, cast(null as integer) as grown_shard, cast(p.vslot as integer) as vslot, 1 as map_version
from _placed p left join _crcs c on p.text = c.text
"""


def sql(docs: str = "documents") -> str:
    return SQL.format(docs=docs, slots=SLOTS, shards=SHARDS)
