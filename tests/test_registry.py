"""Every registered query against its SQL on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from tallyrail.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer orders events".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data is not mounted")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def shown(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = driver.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(shown(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(driver.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    expected = sorted((tuple(shown(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted(names) == columns
    assert got and got == expected
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and "EvalPython" not in plan


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql()) <= set(driver.queries())
