from datetime import datetime

import numpy as np
import pytest

from agoralens.operators import experiments as X


@pytest.fixture
def tables(spark):
    tests = spark.createDataFrame([("a", None), ("b", datetime(2024, 1, 2))], "test_id string, ended_at timestamp")
    variants = spark.createDataFrame(
        [("a", "m0", 3.0), ("a", "m1", 1.0), ("b", "m0", 1.0), ("b", "m2", 1.0)], "test_id string, model_id string, weight double"
    )
    rows = [("a", "m0", datetime(2024, 1, 1), {"latency": float(i), "confidence": 0.5}) for i in range(1, 8)]
    rows += [("b", "m0", datetime(2024, 1, d), {"latency": float(d)}) for d in (1, 2, 3)]
    rows += [("unknown", "m0", datetime(2024, 1, 1), {"latency": 1.0})]
    results = spark.createDataFrame(rows, "test_id string, model_id string, ts timestamp, metrics map<string,double>")
    return tests, variants, results


def test_weights_become_shares(tables):
    got = {(r.test_id, r.model_id): (r.share, r.lower, r.upper) for r in X.normalised_variants(tables[1]).collect()}
    assert got[("a", "m0")] == (0.75, 0.0, 0.75) and got[("a", "m1")] == (0.25, 0.75, 1.0)


def test_assignment_follows_the_weights_and_repeats(spark, tables):
    tests, variants, _ = tables
    units = spark.range(4000).selectExpr("id as user_id", "case when id % 4 = 3 then 'b' else 'a' end as test_id")
    first = {(r.user_id): r.model_id for r in X.assign_variants(units, tests, variants).collect()}
    again = {(r.user_id): r.model_id for r in X.assign_variants(units.repartition(3), tests, variants).collect()}
    assert first == again
    active = [m for u, m in first.items() if u % 4 != 3]
    assert active.count("m0") / len(active) == pytest.approx(0.75, abs=0.03)
    assert all(m is None for u, m in first.items() if u % 4 == 3)


def test_only_active_tests_record(tables):
    tests, _, results = tables
    assert {r.test_id for r in X.recorded_results(results, tests).collect()} == {"a"}


def test_statistics(tables):
    got = {(r.test_id, r.model_id, r.metric): r for r in X.result_statistics(tables[2]).collect()}
    values = np.arange(1, 8)
    r = got[("a", "m0", "latency")]
    assert (r["mean"], r["count"], r.median) == (4.0, 7, 4.0)
    assert r["std"] == pytest.approx(np.std(values)) and r.p95 == pytest.approx(np.percentile(values, 95))
    assert got[("a", "m0", "confidence")]["std"] == 0


def test_final_results_stop_at_the_end(tables):
    tests, variants, results = tables
    got = {r.model_id: r for r in X.final_results(results, tests, variants).collect()}
    assert got["m0"]["count"] == 2 and got["m0"]["mean"] == 1.5
    assert got["m2"].metric is None
