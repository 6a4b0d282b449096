import collections
import zlib

import duckdb
from pyspark.sql import functions as F

from trackspark.llm import mixing, sharding

from .conftest import rows_of


def some(docs, n=600, hot=400):
    return docs(*[(i, f"text {i} " + "x" * (i % 50), "en", "hot" if i < hot else None if i % 7 == 0 else f"s{i % 5}") for i in range(n)])


def test_mixing_follows_weights_and_keeps_columns(docs):
    source = some(docs).drop("mix_copy")
    out = mixing.mix(source, {"hot": 1.0, "s1": 3.0, None: 2.0}, rows=3000)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(n) == {"hot", "s1", None} and abs(n["s1"] / 1500 - 1) < 0.25 and abs(n[None] / 1000 - 1) < 0.25 and abs(n["hot"] / 500 - 1) < 0.25
    assert set(source.columns) < set(out.columns)
    again = mixing.mix(source, {"hot": 1.0, "s1": 3.0, None: 2.0}, rows=3000)
    assert rows_of(out, "doc_id", "mix_copy") == rows_of(again, "doc_id", "mix_copy")


def test_mixing_salted_join_gives_the_same(docs, monkeypatch):
    whole = rows_of(mixing.mix(some(docs)), "doc_id", "mix_copy", "mix_key")
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert rows_of(mixing.mix(some(docs)), "doc_id", "mix_copy", "mix_key") == whole


def test_mixing_high_rates_and_cases(docs):
    assert mixing.mix(docs().limit(0)).count() == 0
    out = mixing.mix(docs((1, None), (None, ""), (2, "x"), (2, "x")), rows=400)
    assert abs(out.count() - 400) < 120 and out.where("doc_id = 2").groupBy("mix_copy").count().where("count % 2 <> 0").count() == 0
    assert mixing.mix(docs((1, "a")), {"b": 1.0}).count() == 0


def test_sharding_balances_bytes_and_fills_slots(docs):
    out = sharding.shard(some(docs, 3000, 1000)).cache()
    by = out.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.countDistinct("slot").alias("d")).collect()
    sizes = [r.b for r in by]
    assert len(by) == 24 and max(sizes) - min(sizes) < 120 and all(r.lo == 0 and r.hi == r.n - 1 == r.d - 1 for r in by)


def test_sharding_cases(docs):
    assert sharding.shard(docs().limit(0)).count() == 0
    rows = sharding.shard(docs((1, None), (1, None), (None, "é"), (2, ""))).collect()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == {(1, 8, 0): 2, (None, 10, zlib.crc32("é".encode())): 1, (2, 8, 0): 1}


def test_sharding_splits_equal_rows(spark, docs):
    source = docs(*[(1, "same")] * 9000, *[(None, "same")] * 30, *[(10 + i, f"text {i}") for i in range(200)])
    records = sharding.slotted(source)
    hot = records.where("doc_id = 1").agg(F.count("*").alias("slots"), F.sum("copies").alias("n"), F.min("copies").alias("least"), F.max("copies").alias("most")).first()
    assert tuple(hot) == (sharding.SLOTS, 9000, 2, 3)
    out = sharding.shard(source).cache()
    assert out.groupBy("doc_id").count().where("doc_id = 1 or doc_id is null").orderBy("count").collect() == [(None, 30), (1, 9000)]
    by = out.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("hi"), F.countDistinct("slot").alias("d")).collect()
    assert len(by) == 24 and all(r.hi == r.n - 1 == r.d - 1 for r in by) and max(r.b for r in by) - min(r.b for r in by) < 60


def test_sharding_of_equal_rows_is_that_of_the_sql(docs):
    rows = [(1, "same")] * 5000 + [(None, "same")] * 3 + [(None, None), (7, None), (7, "")] + [(10 + i, f"text {i}") for i in range(50)]
    with duckdb.connect() as con:
        con.execute("create table repeated (doc_id bigint, text varchar)")
        con.execute("insert into repeated select unnest($a), unnest($b)", {"a": [r[0] for r in rows], "b": [r[1] for r in rows]})
        found = con.execute(sharding.sql("repeated"))
        names = [c[0] for c in found.description]
        assert rows_of(sharding.shard(docs(*rows)), *names) == sorted(found.fetchall(), key=repr)


def test_stored_map_is_edited_when_rebalancing(spark, docs, tmp_path):
    path = str(tmp_path / "map")
    records = sharding.slotted(some(docs, 3000, 1000))
    sharding.save_map(sharding.assign(sharding.slot_sizes(records), 24), path)
    first = sharding.load_map(spark, path)
    grown = sharding.rebalance(records, path, 25)
    assert {r[0] for r in grown.select("version").distinct().collect()} == {2}
    moved = first.select("vslot", F.col("shard").alias("old")).join(grown, "vslot").where("old <> shard")
    assert 0 < moved.count() < 700 and moved.where("shard <> 24").count() < moved.count() / 3
    assert sharding.load_map(spark, path, 1).count() == sharding.SLOTS
