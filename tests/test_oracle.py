"""Every registered query against its SQL on a second engine."""

import datetime as dt
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from hourgrid.plans.catalog import ORACLE, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')"
        )
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, dt.datetime):
        return value.date()
    return value


def ordered(rows):
    return sorted(rows, key=lambda row: [(value is None, str(value)) for value in row])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, oracle, name):
    result = QUERIES[name](spark, FOLDER)
    columns = sorted(result.columns)
    actual = [tuple(plain(row[c]) for c in columns) for row in result.collect()]
    cursor = oracle.execute(ORACLE[name])
    types = {d[0]: str(d[1]) for d in cursor.description}
    assert sorted(types) == columns
    assert {c: TYPES[t] for c, t in result.dtypes} == types
    names = list(types)
    expected = [
        tuple(plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall()
    ]
    assert actual, "a query without rows checks nothing"
    assert ordered(actual) == ordered(expected)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries())


def test_entry_returns_rows(spark):
    assert contract.entry(spark).count() == 958
