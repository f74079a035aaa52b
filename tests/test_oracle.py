"""Every registered query against its SQL counterpart in DuckDB."""

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as entry_point
from laplake.plans import all_queries, oracle_statements

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def _sorted(table):
    names = sorted(table.column_names)
    columns = [table.column(name).to_pylist() for name in names]
    return names, sorted(zip(*columns), key=repr)


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    ours = entry_point.queries()[name](spark, SMALL).toArrow()
    theirs = duck.execute(entry_point.oracle_sql()[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    for column in ours.column_names:
        assert ours.schema.field(column).type == theirs.schema.field(column).type, column
    assert _sorted(ours) == _sorted(theirs)


def test_every_query_has_sql():
    assert set(all_queries()) == set(oracle_statements())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() > 0
