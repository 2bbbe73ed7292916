import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agoralens.operators import ranking as R
from agoralens.operators.quantiles import exact_percentiles


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows share a key; one key is null."""
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "hot", "a", None]), rng.randint(0, 50), i) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "k string, v int, id int").repartition(7)


def first_of(rows, n):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], [])
        if len(out[r[0]]) < n:
            out[r[0]].append(r)
    return sorted((r for rs in out.values() for r in rs), key=lambda r: r[2])


@pytest.mark.parametrize("salts", [1, 5])
def test_first_n_per_key(skewed, salts):
    rows, df = skewed
    got = R.first_n_per_key(df, ["k"], [F.asc("v"), F.asc("id")], 40, salts=salts)
    assert sorted((tuple(r[:3]) for r in got.collect()), key=lambda r: r[2]) == first_of(rows, 40)


def test_first_n_by_cutoff_keeps_small_and_null_keys(skewed):
    rows, df = skewed
    got = R.first_n_by_cutoff(df, ["k"], F.struct("v", "id"), 700)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[2]) == first_of(rows, 700)


def test_first_n(skewed):
    rows, df = skewed
    want = sorted(rows, key=lambda r: (r[1], r[2]))
    for n in (3, 100):
        assert [tuple(r) for r in R.first_n(df, [F.asc("v"), F.asc("id")], n).collect()] == want[:n]


def test_partial_limit_comes_before_the_shuffle(skewed):
    _, df = skewed
    plan = R.first_n_per_key(df, ["k"], [F.asc("v"), F.asc("id")], 5000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4


def test_newest_first_puts_missing_times_last(spark):
    rows = [("k", "2024-01-02 00:00:00", "a"), ("k", None, "b"), ("k", "2024-01-03 00:00:00", "c")]
    df = spark.createDataFrame(rows, "k string, at string, id string").withColumn("at", F.to_timestamp("at"))
    got = R.first_n_by_cutoff(df, ["k"], R.newest_first("at", "id"), 2)
    assert sorted(r.id for r in got.collect()) == ["a", "c"]


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_hash_cutoffs_and_ranks_agree_with_sorting(spark, digits):
    rows = [("a" if i % 3 else "b", i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, id int").withColumn("key", R.hash_key(F.col("id"), 42))
    ranks = R.hash_rank(df, "g", "key", "r", digits).collect()
    for group in "ab":
        ordered = sorted((r for r in ranks if r.g == group), key=lambda r: r.key)
        assert [r.r for r in ordered] == list(range(1, len(ordered) + 1))
    cut = {r.g: r.cutoff for r in R.hash_cutoffs(df, "g", "key", F.lit(120), digits).collect()}
    assert cut == {r.g: r.key for r in ranks if r.r == 120}
    assert R.hash_cutoffs(df, "g", "key", F.lit(0), digits).count() == 0


def _percentile(ordered, p):
    """Linear interpolation; equal ends are the value itself, also where they are infinite."""
    at = p * (len(ordered) - 1)
    low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
    return low if low == high else low + (high - low) * (at - np.floor(at))


@pytest.mark.parametrize("ordered, buckets", [(100_000, 4096), (50, 64), (10, 16)])
def test_exact_percentiles(spark, ordered, buckets):
    """Small limits make the search take several rounds."""
    rng = np.random.default_rng(5)
    groups = {
        "normal": rng.normal(size=4000),
        "ties": rng.integers(0, 3, size=3000).astype(float),
        "outlier": np.append(rng.random(1500), 1e12),
        "wide": np.concatenate([-(10.0 ** rng.uniform(-300, 300, 400)), 10.0 ** rng.uniform(-300, 300, 401)]),
        None: rng.random(500),
        "one": np.array([4.0]),
        "two": np.array([1.0, 2.0]),
        "infinite": np.append(rng.random(800), [np.inf] * 100),
        "both": np.concatenate([[-np.inf] * 300, rng.normal(size=500), [np.inf] * 200]),
        "only": np.array([np.inf] * 3),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("one", None), ("one", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    points = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {r.g: r for r in exact_percentiles(df, ["g"], "v", points, buckets, ordered).collect()}
    for name, values in groups.items():
        want = [_percentile(np.sort(values), p) for p in points]
        have = [got[name][f"p_{p:g}".replace(".", "_")] for p in points]
        assert have == pytest.approx(list(want)), name
    df = df.filter("abs(v) < double('Infinity')")
    groups = {k: v[np.isfinite(v)] for k, v in groups.items()}
    total = exact_percentiles(df, [], "v", [0.5], buckets, ordered).first()[0]
    assert total == pytest.approx(np.percentile(np.concatenate(list(groups.values())), 50))
