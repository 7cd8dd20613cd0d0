"""Every registered query against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest
from session_records import SF

import __spark_entry__ as entry
from sessionloom import oracles, queries


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def tidy(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    data = [tuple(r) for r in got.collect()]
    if name in oracles.ORACLES:
        want = duck.sql(oracles.ORACLES[name])
        assert sorted(want.columns) == sorted(got.columns)
        assert tidy(got.columns, data) == tidy(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
