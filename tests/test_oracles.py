"""Every core query with SQL gives what DuckDB gives."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from attestry.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'").fetchall()
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, db, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    run = db.execute(SQL[name])
    named = [d[0] for d in run.description]
    assert sorted(named) == columns
    expected = sorted((tuple(plain(r[named.index(c)]) for c in columns) for r in run.fetchall()), key=str)
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_push_down_and_join_on_keys(spark, data):
    page = plan(QUERIES["batch_page_keyset"](spark, data))
    assert "PushedFilters: [" in page and "payload_json" not in page
    nearest = plan(QUERIES["nearest_earlier_embedding"](spark, data))
    assert "CartesianProduct" not in nearest and "NestedLoop" not in nearest
    assert "payload_json" not in plan(QUERIES["kpis"](spark, data))
