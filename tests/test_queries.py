"""Registered queries against the same query in SQL on the small tables; every sixth one, or all with ALL_QUERIES=1."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(entry.registry.ORACLE_SQL)


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES if os.environ.get("ALL_QUERIES") else NAMES[::6])
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    rel = db.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    want = sorted(repr([plain(r[rel.columns.index(c)]) for c in cols]) for r in rel.fetchall())
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).columns


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
