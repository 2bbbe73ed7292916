import pytest

from agoralens.operators import evaluation as E


@pytest.fixture
def pairs(spark):
    def make(counts):
        rows = [(t, p, f"{t}-{p}-{i}", i) for (t, p), n in counts.items() for i in range(n)]
        return spark.createDataFrame(rows, "sentiment string, predicted_label string, text string, id int")

    return make


def test_matrix_keeps_zeros(pairs):
    rows = E.confusion_matrix(pairs({("positive", "positive"): 3, ("positive", "negative"): 1})).collect()
    got = {r.true_label: (r.predicted_negative, r.predicted_neutral, r.predicted_positive) for r in rows}
    assert got == {"negative": (0, 0, 0), "neutral": (0, 0, 0), "positive": (1, 0, 3)}
    assert [r.label for r in rows] == [0, 1, 2]


def test_report(pairs):
    df = pairs({("negative", "negative"): 2, ("negative", "positive"): 2, ("positive", "positive"): 4})
    got = {r.row: r for r in E.classification_report(df).collect()}
    assert (got["negative"].precision, got["negative"].recall, got["negative"].support) == (1.0, 0.5, 4)
    assert got["positive"].precision == pytest.approx(4 / 6) and got["positive"].f1_score == pytest.approx(0.8)
    assert (got["neutral"].precision, got["neutral"].recall, got["neutral"].f1_score, got["neutral"].support) == (0, 0, 0, 0)
    assert got["accuracy"].f1_score == 0.75 and got["accuracy"].precision is None
    assert got["macro avg"].recall == pytest.approx(0.5)
    assert got["weighted avg"].precision == pytest.approx((1.0 * 4 + 4 / 6 * 4) / 8)


def test_report_of_nothing(pairs, spark):
    df = spark.createDataFrame([], "sentiment string, predicted_label string")
    assert all(not r.support and not r.f1_score for r in E.classification_report(df).collect())


def test_examples_are_the_first_of_each_wrong_pair(pairs):
    df = pairs({("negative", "positive"): 5, ("neutral", "negative"): 1, ("positive", "positive"): 9}).repartition(6)
    got = {(r.true_label, r.predicted_label): (r["count"], r.examples) for r in E.error_examples(df, "id").collect()}
    assert got == {
        ("negative", "positive"): (5, [f"negative-positive-{i}" for i in range(3)]),
        ("neutral", "negative"): (1, ["neutral-negative-0"]),
    }
