"""Every registered query with SQL gives the rows of its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = {k: v for k, v in __spark_entry__.catalog.ORACLE.items()}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(row):
    return tuple(repr(v + 0.0) if isinstance(v, float) else repr(v) for v in row)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = __spark_entry__.catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(map(plain, df.select(*columns).collect()))
    r = duck.execute(SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    order = sorted(range(len(names)), key=names.__getitem__)
    assert got == sorted(plain([row[i] for i in order]) for row in r.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
