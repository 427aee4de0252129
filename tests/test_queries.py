"""Every engine query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from quarry.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: ("nan" if math.isnan(x) else round(x + 0.0, 6)) if isinstance(x, float) else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, sql, name):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    result = sql.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal(map(tuple, got), df.columns) == normal(result.fetchall(), columns)
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
    spark.catalog.clearCache()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
