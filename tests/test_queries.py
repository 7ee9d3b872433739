"""Every query with SQL gives the rows of its SQL in DuckDB, with the same types."""

import os

import duckdb
import pytest

from riftscan.plans.catalog import ORACLE_SQL, QUERIES

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"create view {t.split('.')[0]} as select * from '{sf}/{t}'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(str(tuple(round(r[k], 9) if isinstance(r[k], float) else r[k] for k in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    assert got
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name])
        assert {c: TYPES.get(t, t) for c, t in df.dtypes} == dict(zip(want.columns, map(str, want.types)))
        assert rows_of(df.columns, got) == rows_of(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
