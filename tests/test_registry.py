"""The entry point, and the queries against DuckDB on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from chronoframe.plans import registry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables are not here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_against_sql(spark, db, name):
    df, want = registry.QUERIES[name](spark, SF), db.sql(registry.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
