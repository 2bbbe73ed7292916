"""Every named query against its SQL on the smallest test tables."""

import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from agoralens.catalog.checks import CHECKS
from agoralens.catalog.queries import QUERIES
from agoralens.operators import experiments


@pytest.fixture(scope="module")
def database(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def normal(value):
    if isinstance(value, (float, decimal.Decimal)):
        return f"{round(float(value), 6) + 0.0:.6f}"
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([normal(r[i]) for i in order] for r in rows)


def test_only_training_lacks_a_check():
    assert set(QUERIES) - set(CHECKS) == {"train_and_predict"}
    assert set(CHECKS) <= set(QUERIES)
    assert set(QUERIES) <= set(entry_points.queries()) and set(CHECKS) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, database, name):
    df = QUERIES[name](spark, sf_dir)
    got = table(df.columns, df.collect())
    assert got[1]
    if name in CHECKS:
        result = database.execute(CHECKS[name])
        assert got == table([d[0] for d in result.description], result.fetchall())


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["day", "negative", "neutral", "positive"]
    assert df.count() == 30


@pytest.mark.parametrize("name", ["community_categories", "ab_recorded"])
def test_facts_are_not_shuffled_by_a_key_of_few_values(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_results_meet_ended_tests_by_broadcast(spark):
    tests = spark.createDataFrame([("a", None)], "test_id string, ended_at timestamp")
    results = spark.range(1000).selectExpr("concat('t', id % 2) as test_id", "id")
    plan = results.join(experiments._known(tests), "test_id")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan
