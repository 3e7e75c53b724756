"""Every registered query with oracle SQL gives DuckDB's rows."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from cloakframe.plans import registry, registry_more
from cloakframe.plans.registry import TABLES

QUERIES, SQL = registry.QUERIES | registry_more.QUERIES, registry.SQL | registry_more.SQL

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, DIR)
    want = con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = plain(tuple(r[c] for c in order) for r in got.collect())
    expected = plain(tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall())
    assert rows == expected
    assert rows and not any(isinstance(x, float) and math.isnan(x) for r in rows for x in r)


@pytest.mark.parametrize("name", sorted(n for n in SQL if n.startswith(("mask_", "masked_", "detect_", "summary_", "low_", "explain_", "decisions_", "nhi_", "ird_", "sink_"))))
def test_plans_compile(spark, name):
    """With the way out for generated code that is too large closed, the plans still run."""
    closed = {"spark.sql.codegen.fallback": "false", "spark.sql.codegen.factoryMode": "CODEGEN_ONLY"}
    try:
        for k, v in closed.items():
            spark.conf.set(k, v)
        assert entry.queries()[name](spark, "/root/testdata/sf0.001").collect()
    finally:
        for k in closed:
            spark.conf.unset(k)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
