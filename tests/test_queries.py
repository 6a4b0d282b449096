"""Every query with SQL against the other engine, on the smallest tables; all others must give rows."""

import collections
import datetime
import decimal
import math
import os

import duckdb
import pytest

from trackspark.plans.catalog import REGISTRY
from trackspark.sources.fixtures import TABLES

DATA = os.environ.get("TEST_DATA", "/root/testdata") + "/sf0.001"


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, datetime.date)):
        return v
    if isinstance(v, (float, int, decimal.Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 5) + 0.0
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return tuple(map(plain, v))


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(REGISTRY.queries))
def test_query(spark, other, name):
    df = REGISTRY.queries[name](spark, DATA)
    columns = sorted(df.columns)
    got = collections.Counter(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in REGISTRY.oracles:
        assert got
        return
    found = other.execute(REGISTRY.oracles[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = collections.Counter(repr([plain(r[i]) for i in order]) for r in found.fetchall())
    assert got == want
