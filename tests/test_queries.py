"""Registered queries against DuckDB on the driver tables."""

import os

import duckdb
import pytest

from relstream.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in names)) for r in df.collect())
    if name not in registry.ORACLES:
        assert got
        return
    cur = duck.execute(registry.ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == names
    assert got == sorted(repr(tuple(r[cols.index(c)] for c in names)) for r in cur.fetchall())


def test_entry_points_work_without_the_text_operators(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = registry.QUERIES["filter_events"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type)" in plan and "props" not in plan.split("ReadSchema")[1]


def test_top_n_is_limited_before_the_shuffle(spark):
    plan = registry.QUERIES["topn_per_group"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_sketches_are_formed_once_per_group_not_per_value(spark):
    """A sketch of 2 % takes kilobytes, so a shuffle by group and value must not carry one for each value."""
    plan = registry.QUERIES["approx_distinct_bound"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    steps = [line for line in plan.splitlines() if "HashAggregate(keys=[l_returnflag" in line or "ObjectHashAggregate" in line]
    assert steps and not any("approx_count_distinct" in s and "l_partkey" in s.split("functions=")[0] for s in steps), plan
