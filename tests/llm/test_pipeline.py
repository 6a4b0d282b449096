import collections
import hashlib
import math
import zlib

import pyarrow as pa

import corpus_pipeline as p
from trackspark.llm import common, decontamination, mixing, sharding

from .conftest import rows_of
from .test_brute import PlainLanguage
from .test_ngramjoin import brute

DATA = "/root/testdata/sf0.001"


def plain_copies(rows):
    """Each document as often as its hash says, at the rate of its source."""
    n = collections.Counter(r.source for r in rows)
    weight = {s: k**mixing.ALPHA for s, k in n.items()}
    for r in rows:
        rate = weight[r.source] / sum(weight.values()) * len(rows) / n[r.source]
        draws = max(1, math.ceil(rate / mixing.LARGEST_MEAN))
        ident = f"{mixing.SEED}|{r.doc_id}|{hashlib.md5((r.text or '').encode()).hexdigest()}"
        for d in range(draws):
            u = int(hashlib.md5((ident + (f"|{d + 1}" if d else "")).encode()).hexdigest()[:8], 16) / 2**32
            k, term = 0, math.exp(-rate / draws)
            total = term
            while total <= u:
                k += 1
                term *= rate / draws / k
                total += term
            yield from [r.doc_id] * k


def check_shards(before, rows):
    """Every row has a place; places are without gaps; sizes differ by a few records at most."""
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((r.doc_id, size(r.text), zlib.crc32((r.text or "").encode())) for r in before)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) <= set(range(24)) and all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    sums = [sum(r.size for r in x) for x in by.values()]
    assert max(sums) - min(sums) <= 4 * max(r.size for r in rows)


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    names = [n for n, _ in p.STAGES]
    assert names == ["language", "near_duplicates", "decontaminate", "mix", "shard"]
    left = docs
    for name, stage in p.STAGES:
        before = left.collect()
        out = stage(spark, left, DATA)
        if name == "language":
            model = PlainLanguage([(r.text, r.lang) for r in before if r.lang is not None])
            found = {r.doc_id: model.predict(r.text) for r in before}
            want = sorted(i for i, f in found.items() if f[0] != "und" and f[1] >= p.LEAST_SCORE)
        elif name == "near_duplicates":
            groups = brute([(r.doc_id, r.text) for r in before], 5, 80)
            want = sorted(i for i, _, c in groups if i == c)
        elif name == "decontaminate":
            want = sorted(r.doc_id for r in before if not decontamination.brute(r.text, bench)["contaminated"])
        elif name == "mix":
            want = sorted(plain_copies(before))
        else:
            want = sorted(r.doc_id for r in before)
            check_shards(before, out.collect())
        assert sorted(r.doc_id for r in out.collect()) == want, name
        if name != "shard":
            assert tuple(out.columns) == p.DOCUMENTS
        left = spark.createDataFrame(out.collect(), out.schema)


def test_run_is_the_chain_of_stages_and_takes_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(900, None, None, None, None), (901, "", "en", "a", 0), (None, "The and of that", "en", "a", 15), (902, "12 34", "en", None, 5)], docs.schema)
    for name, df in (("documents", docs.union(odd).union(odd)), ("benchmark", spark.read.parquet(f"{DATA}/benchmark.parquet"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    out = p.run(spark, str(tmp_path))
    assert set(out.columns) >= {"doc_id", "shard", "slot"} and out.where("doc_id in (900, 901, 902)").count() == 0 and out.count() > 100
    for name, df in (("documents", docs.limit(0)), ("benchmark", spark.read.parquet(f"{DATA}/benchmark.parquet"))):
        df.write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert p.run(spark, f"{tmp_path}/none").count() == 0
    assert rows_of(sharding.shard(docs.limit(0)), "doc_id") == []


def test_texts_go_to_python_in_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    docs, before = spark.read.parquet(f"{DATA}/documents.parquet"), spark.conf.get(common.BATCH_ROWS)
    for _, stage in p.STAGES[:3]:
        try:
            out = stage(spark, docs, DATA)
            assert {r.n for r in spark.range(0, 2500, 1, 1).mapInArrow(sizes, "n long").collect()} == {1000, 500} and out.count()
        finally:
            spark.conf.set(common.BATCH_ROWS, before)
    p.run(spark, DATA)
    assert spark.conf.get(common.BATCH_ROWS) == before
