"""Every query of the catalogue against its SQL, as the driver does it."""

import os

import duckdb
import pytest

from graphmem import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(small):
    c = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{small}/{name}.parquet"):
            c.execute(f"create view {name} as select * from read_parquet('{small}/{name}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, duck, small, name):
    got = catalog.QUERIES[name](spark, small)
    asked = duck.sql(catalog.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(asked.columns)
    rows = sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect())))
    place = [asked.columns.index(c) for c in columns]
    assert rows == sorted(repr(tuple(r[i] for i in place)) for r in asked.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0
