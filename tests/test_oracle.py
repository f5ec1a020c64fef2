"""Every registered query with a SQL twin gives the same rows."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, compare

from .conftest import SF

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    df = queries()[name](spark, SF)
    cur = con.execute(SQL[name])
    want = ([d[0] for d in cur.description], cur.fetchall())
    assert compare((df.columns, [tuple(r) for r in df.collect()]), want) == ""


def test_entry(spark):
    assert entry(spark).count() == 10


def test_sql_names_are_registered():
    assert set(SQL) <= set(queries())
