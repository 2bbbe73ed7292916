"""Counters, histograms and windows over prediction, request and error events.

The event table has one row per request: prediction_id, ts, sentiment,
confidence, model_version, endpoint, method, latency_seconds, error_type.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.wordlists import LABELS
from .ranking import first_n, first_n_per_key

# Upper bounds of the histogram buckets.
REQUEST_LATENCY_BOUNDS = [0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]
DEFAULT_LATENCY_BOUNDS = [
    0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0,
]
CONFIDENCE_BOUNDS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
PREDICTION_ENDPOINTS = ["/predict", "/predict/batch"]
DRIFT_WINDOW = 100
PERFORMANCE_WINDOW = 1000


def counter(events: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Events per combination of labels."""
    return events.groupBy(*labels).agg(F.count(F.lit(1)).alias("value"))


def request_counter(events: DataFrame) -> DataFrame:
    return counter(events, ["endpoint", "method"])


def prediction_counter(events: DataFrame) -> DataFrame:
    return counter(events, ["sentiment"])


def error_counter(events: DataFrame) -> DataFrame:
    return counter(events.filter("error_type is not null"), ["model_version", "error_type"])


def histogram_columns(value: str, bounds: Sequence[float]) -> list[Column]:
    """Cumulative bucket counts, sum and count as aggregate columns."""
    buckets = [F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]
    return [*buckets, F.sum(value).alias("sum"), F.count(value).alias("count")]


def bucket_rows(bounds: Sequence[float]) -> Column:
    """The bucket columns as rows of ``le`` and ``bucket_count``; the last bound is +Inf."""
    rows = [
        F.struct(F.lit(f"{b:g}" if b != int(b) else f"{b:.1f}").alias("le"), F.col(f"le_{i}").alias("bucket_count"))
        for i, b in enumerate(bounds)
    ]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("bucket_count")))
    return F.inline(F.array(*rows))


def histogram(events: DataFrame, labels: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """One row per label combination and bucket; one pass with partial aggregates."""
    counted = events.groupBy(*labels).agg(*histogram_columns(value, bounds))
    return counted.select(*labels, "sum", "count", bucket_rows(bounds))


def latency_histogram(events: DataFrame, bounds: Sequence[float] = REQUEST_LATENCY_BOUNDS) -> DataFrame:
    return histogram(events, ["endpoint"], "latency_seconds", bounds)


def inference_histogram(events: DataFrame) -> DataFrame:
    return histogram(events, ["model_version"], "latency_seconds", DEFAULT_LATENCY_BOUNDS)


def confidence_histogram(events: DataFrame, labels: Sequence[str] = ()) -> DataFrame:
    return histogram(events, labels, "confidence", CONFIDENCE_BOUNDS)



def _latest_first() -> list[Column]:
    return [F.desc("ts"), F.desc("prediction_id")]


def latest(events: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """The last ``n`` events, of all or per key."""
    order = _latest_first()
    return first_n_per_key(events, by, order, n) if by else first_n(events, order, n)


def drift(events: DataFrame, window: int = DRIFT_WINDOW, by: Sequence[str] = ()) -> DataFrame:
    """Label shares and spread of the confidence over the last predictions.

    Nothing is reported for fewer than ``window`` predictions.
    """
    needed = events.select(*by, "ts", "prediction_id", "sentiment", "confidence")
    return (
        latest(needed, window, by)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[(F.count_if(F.col("sentiment") == s) / F.lit(float(window))).alias(f"{s}_share") for s in LABELS],
            F.avg("confidence").alias("average_confidence"),
            F.stddev_pop("confidence").alias("confidence_std"),
        )
        .filter(F.col("n") == window)
        .drop("n")
    )


def performance(
    events: DataFrame,
    window: int = PERFORMANCE_WINDOW,
    by: Sequence[str] = (),
    model_version: str | None = None,
) -> DataFrame:
    """Summary of the last predictions; zeros when there are none."""
    if model_version is not None:
        events = events.filter(F.col("model_version") == model_version)
    needed = events.select(*by, "ts", "prediction_id", "sentiment", "confidence")

    def or_zero(value: Column) -> Column:
        return F.coalesce(value, F.lit(0.0))

    # At most ``window`` values reach the exact median.
    return (
        latest(needed, window, by)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("total_predictions"),
            or_zero(F.avg("confidence")).alias("avg_confidence"),
            or_zero(F.median("confidence")).alias("median_confidence"),
            or_zero(F.min("confidence")).alias("min_confidence"),
            or_zero(F.max("confidence")).alias("max_confidence"),
            *[F.count_if(F.col("sentiment") == s).alias(f"{s}_count") for s in LABELS],
        )
    )


def last_predictions(events: DataFrame, n: int = 10) -> DataFrame:
    return latest(events, n)


def error_totals(events: DataFrame) -> DataFrame:
    """Errors by type with the total over all types; without errors one row of no type, with zeros."""
    by_type = events.filter("error_type is not null").groupBy("error_type").agg(F.count(F.lit(1)).alias("errors"))
    total = events.agg(F.count("error_type").alias("t"))
    none = total.filter("t = 0").select(F.lit(None).cast("string").alias("error_type"), F.col("t").alias("errors"))
    return by_type.unionByName(none).withColumn("error_count", total.scalar())


def service_summary(events: DataFrame) -> DataFrame:
    """Predictions per label and prediction requests, as one row."""
    is_prediction = F.col("endpoint").isin(PREDICTION_ENDPOINTS) & (F.col("method") == "POST")
    return events.agg(
        *[F.count_if(F.col("sentiment") == s).alias(f"{s}_predictions") for s in LABELS],
        F.count_if(is_prediction).cast("double").alias("total_requests"),
    )
