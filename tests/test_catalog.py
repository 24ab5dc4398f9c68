"""Every registered reference query with SQL gives the rows of another engine; the others are run."""

import math
import os

import duckdb
import pytest

from tractus.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def text(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", SQL)
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    rel = duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    assert sorted(tuple(text(r[c]) for c in columns) for r in got) == sorted(tuple(text(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"scan_siscan"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_planted_tracts_are_the_events(spark):
    for r in QUERIES["cyclic_scan"](spark, SF).filter("round = 1").collect():
        assert r.recombinant in (0, 1, 2) and r.supports >= 1


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["name_search"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan and "text" not in plan.split("ReadSchema")[1].split("\n")[0]
    plan = QUERIES["sequence_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
