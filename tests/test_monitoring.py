from datetime import datetime, timedelta

import numpy as np
import pytest

from agoralens.operators import monitoring as O

SCHEMA = (
    "prediction_id bigint, ts timestamp, sentiment string, confidence double, model_version string, endpoint string,"
    " method string, latency_seconds double, error_type string"
)


@pytest.fixture
def events(spark):
    def make(confidences, **extra):
        start = datetime(2024, 1, 1)
        labels = ["positive", "negative", "neutral"]
        rows = [
            (i, start + timedelta(seconds=i), labels[i % 3], c, extra.get("version", f"v{i % 2}"),
             ["/predict", "/predict/batch", "/health"][i % 3], "GET" if i % 3 == 2 else "POST", c, "E" if i % 5 == 0 else None)
            for i, c in enumerate(confidences)
        ]
        return spark.createDataFrame(rows, SCHEMA).repartition(4)

    return make


def test_performance(events):
    r = O.performance(events([0.7, 0.8, 0.9])).first()
    assert (r.total_predictions, r.min_confidence, r.max_confidence) == (3, 0.7, 0.9)
    assert r.avg_confidence == pytest.approx(0.8) and r.median_confidence == pytest.approx(0.8)
    assert (r.positive_count, r.negative_count, r.neutral_count) == (1, 1, 1)


def test_performance_of_nothing_is_zero(events):
    r = O.performance(events([])).first()
    assert (r.total_predictions, r.avg_confidence, r.max_confidence) == (0, 0, 0)


def test_performance_window_and_version(events):
    df = events([i / 100 for i in range(50)])
    assert O.performance(df, 10).first().min_confidence == pytest.approx(0.40)
    only = O.performance(df, 10, model_version="v1").first()
    assert only.min_confidence == pytest.approx(0.31)
    per = {r.model_version: r.total_predictions for r in O.performance(df, 10, ["model_version"]).collect()}
    assert per == {"v0": 10, "v1": 10}


def test_drift_needs_a_full_window(events):
    assert O.drift(events([0.5] * 99)).count() == 0
    values = [i / 1000 for i in range(150)]
    r = O.drift(events(values)).first()
    assert r.average_confidence == pytest.approx(np.mean(values[-100:]))
    assert r.confidence_std == pytest.approx(np.std(values[-100:]))
    assert r.positive_share + r.negative_share + r.neutral_share == pytest.approx(1)
    assert O.drift(events(values), by=["model_version"]).count() == 0


def test_counters(events):
    df = events([0.5] * 10)
    assert {(r.endpoint, r.method): r.value for r in O.request_counter(df).collect()} == {
        ("/predict", "POST"): 4, ("/predict/batch", "POST"): 3, ("/health", "GET"): 3,
    }
    assert {r.sentiment: r.value for r in O.prediction_counter(df).collect()} == {"positive": 4, "negative": 3, "neutral": 3}
    assert sum(r.value for r in O.error_counter(df).collect()) == 2
    assert O.error_totals(df).first().error_count == 2
    s = O.service_summary(df).first()
    assert (s.total_requests, s.positive_predictions) == (7.0, 4)


def test_histogram_is_cumulative(events):
    rows = {r.le: r for r in O.confidence_histogram(events([0.05, 0.1, 0.11, 1.0, 1.5])).collect()}
    assert [rows[le].bucket_count for le in ("0.1", "0.2", "0.9", "1.0", "+Inf")] == [2, 3, 3, 4, 5]
    assert rows["+Inf"]["count"] == 5 and rows["+Inf"]["sum"] == pytest.approx(2.76)


def test_histogram_bounds_by_label(events):
    df = events([0.3, 6.0, 11.0], version="v1")
    got = {(r.model_version, r.le): r.bucket_count for r in O.inference_histogram(df).collect()}
    assert got[("v1", "0.25")] == 0 and got[("v1", "0.5")] == 1 and got[("v1", "7.5")] == 2 and got[("v1", "+Inf")] == 3
    assert len(got) == 15
    assert O.latency_histogram(df).count() == 3 * 10


def test_last_predictions(events):
    got = [r.prediction_id for r in O.last_predictions(events([0.5] * 30)).collect()]
    assert got == list(range(29, 19, -1))


def test_no_errors_is_a_total_of_zero(spark):
    events = spark.createDataFrame([(None,), (None,)], "error_type string")
    for df in (events, events.limit(0)):
        assert [tuple(r) for r in O.error_totals(df).collect()] == [(None, 0, 0)]
