"""Every catalogue query against its SQL check on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from requestloom.plans.catalog import CATALOG
from tools.check import TABLES, rows_of

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, got) == rows_of(cols, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_a_check():
    assert set(CATALOG) <= set(entry.queries())
    assert set(CATALOG) <= set(entry.oracle_sql())
