"""Every registered query against its SQL, on whole tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_point
from mailfleet.catalog import ORACLES, QUERIES
from mailfleet.sources.fixtures import TABLES, view_sql, with_views
from tests.compare import oracle_rows, rows_of


@pytest.fixture(scope="module")
def duck(folder):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, folder, duck):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = rows_of(df, *columns)
    assert got == oracle_rows(duck, ORACLES[name], columns)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLES) <= set(entry_point.oracle_sql())


def test_entry(spark):
    rows = {r.route: r.recipients for r in entry_point.entry(spark).collect()}
    assert sum(rows.values()) == 1500 and rows["relay_denied"] > 0


@pytest.mark.parametrize("name", sorted(view_sql()))
def test_views_agree(name, spark, folder, duck):
    from mailfleet.sources.fixtures import Views

    df = Views(spark, folder)(name)
    columns = sorted(df.columns)
    assert rows_of(df, *columns) == oracle_rows(
        duck, with_views(f"select * from {name}"), columns
    )
