"""Every query that has SQL against DuckDB over whole tables."""

import os

import __spark_entry__ as e
import duckdb
import pytest
from weftspark.plans import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(repr([r[c] for c in columns]) for r in df.collect())
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert found == sorted(repr([r[names.index(c)] for c in columns]) for r in result.fetchall())


def test_entry_has_rows(spark):
    assert e.entry(spark).count() > 0


def test_every_query_of_the_library_is_registered():
    assert set(SQL) <= set(registry.queries()) <= set(e.queries())
