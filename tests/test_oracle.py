"""Every registered query against its SQL, on the smallest data."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import DATA

TABLES = ["conversations", "benchmark", "pages", "documents", "labels", "embeddings"]


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, con, name):
    result = entry.queries()[name](spark, DATA)
    columns = sorted(result.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in result.collect()), key=repr)
    assert rows or name == "speaker_regex"
    if name not in entry.oracle_sql():
        return
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
    assert rows == expected


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 24
