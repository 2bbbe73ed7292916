"""A/B tests: variants, assignment and results.

Tables: tests (test_id, ended_at), variants (test_id, model_id, weight), results
(test_id, model_id, ts, metrics map<string,double>).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .quantiles import exact_percentiles
from .ranking import join_null_safe


def normalised_variants(variants: DataFrame) -> DataFrame:
    """Weights as shares of their test, with the interval each variant covers in [0, 1)."""
    test = Window.partitionBy("test_id")
    upto = test.orderBy("model_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("weight").over(test)
    return (
        variants.withColumn("share", F.col("weight") / total)
        .withColumn("upper", F.sum("weight").over(upto) / total)
        .withColumn("lower", F.col("upper") - F.col("share"))
    )


def active_tests(tests: DataFrame) -> DataFrame:
    return tests.filter("ended_at is null")


def ended_tests(tests: DataFrame) -> DataFrame:
    return tests.filter("ended_at is not null")


def _known(tests: DataFrame) -> DataFrame:
    """Written down, so that the planner knows how few tests there are and leaves the results where they are."""
    return materialize(tests, "tests")


def assign_variants(units: DataFrame, tests: DataFrame, variants: DataFrame, unit: str = "user_id") -> DataFrame:
    """Give each unit of an active test one of its variants, with the weights as odds.

    The draw is a hash of unit and test, so an assignment can be repeated.  A test
    is one row holding its variants; units of an unknown or ended test get no variant.
    """
    interval = F.struct("upper", "model_id")
    per_test = (
        normalised_variants(variants)
        .join(active_tests(tests).select("test_id"), "test_id", "left_semi")
        .groupBy("test_id")
        .agg(F.array_sort(F.collect_list(interval)).alias("_variants"))
    )
    ticket = F.md5(F.concat_ws("|", F.col(unit).cast("string"), F.col("test_id")))
    draw = F.conv(F.substring(ticket, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    chosen = F.filter("_variants", lambda v: F.col("draw") < v["upper"])
    # Rounding may leave the last bound just below 1.
    pick = F.coalesce(F.try_element_at(chosen, F.lit(1)), F.try_element_at("_variants", F.lit(-1)))
    return (
        units.join(per_test, "test_id", "left")
        .withColumn("draw", draw)
        .withColumn("model_id", pick["model_id"])
        .drop("_variants")
    )


def recorded_results(results: DataFrame, tests: DataFrame) -> DataFrame:
    """Results that belong to an active test; others are not recorded."""
    return results.join(_known(active_tests(tests).select("test_id")), "test_id", "left_semi")


def result_statistics(results: DataFrame) -> DataFrame:
    """Mean, population deviation, count, median and 95th percentile per test, model and metric.

    Nulls and NaNs are left out of all of them.
    """
    keys = ["test_id", "model_id", "metric"]
    long = results.select("test_id", "model_id", F.explode("metrics").alias("metric", "value"))
    long = materialize(long.withColumn("value", F.nullif(F.col("value").cast("double"), F.lit(float("nan")))), "metrics")
    moments = long.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("count")
    )
    points = exact_percentiles(long, keys, "value", [0.5, 0.95])
    return join_null_safe(moments, points, keys, "left").select(
        *keys, "mean", "std", "count", F.col("p_0_5").alias("median"), F.col("p_0_95").alias("p95")
    )


def final_results(results: DataFrame, tests: DataFrame, variants: DataFrame) -> DataFrame:
    """Snapshot of ended tests: their statistics over the results up to the end.

    Every variant of the test is listed; one without results has null statistics.
    """
    ended = _known(ended_tests(tests).select("test_id", "ended_at"))
    within = results.join(ended, "test_id").filter(F.col("ts") <= F.col("ended_at")).select(results.columns)
    listed = variants.select("test_id", "model_id").join(ended, "test_id")
    return listed.join(result_statistics(within), ["test_id", "model_id"], "left")
