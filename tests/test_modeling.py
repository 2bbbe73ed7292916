import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from agoralens.operators import modeling as M
from agoralens.operators import scoring as S
from agoralens.plans.engineer import train_and_evaluate
from agoralens.plans.preprocess import preprocess
from agoralens.session import materialize, shared_dir


def test_feature_columns_go_by_prefix_and_type(spark):
    df = spark.createDataFrame(
        [("a", "positive", 0.5, 0.1, 1, "x")],
        "processed_text string, sentiment string, tfidf_word_1 double, sentiment_score_1 double, score_metric_1 int,"
        " score_name string",
    )
    assert M.feature_columns(df) == ["tfidf_word_1", "sentiment_score_1", "score_metric_1"]


def test_standardizer_learns_from_train_only(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0), (float("nan"), 5.0)], "a double, b double")
    scaling = M.Standardizer.fit(train, ["a", "b"])
    assert scaling.means == {"a": 1.0, "b": 5.0}
    assert scaling.deviations["a"] == pytest.approx(1.5**0.5) and scaling.deviations["b"] == 1.0
    other = scaling.transform(spark.createDataFrame([(None, 6.0)], "a double, b double")).first()
    assert (other.a, other.b) == (pytest.approx(-1 / 1.5**0.5), 1.0)


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [
        (str(i), name, Vectors.sparse(3, [k], [1.0 + i % 3]), float(k) + (i % 5) / 10)
        for i in range(60)
        for k, name in [(i % 3, ["negative", "neutral", "positive"][i % 3])]
    ]
    return spark.createDataFrame(rows, ["comment_id", "sentiment", "tfidf", "score_log"])


def test_model_learns_predicts_and_survives_saving(spark, labelled):
    model = M.train_model(labelled)
    out = model.predict(labelled).collect()
    assert all(r.sentiment == r.predicted_label for r in out)
    assert all(abs(sum(r.probabilities.values()) - 1) < 1e-9 and r.confidence == max(r.probabilities.values()) for r in out)
    path = shared_dir(spark, "model")
    model.save(path)
    again = M.SentimentModel.load(path)
    assert sorted(map(str, again.predict(labelled).collect())) == sorted(map(str, out))
    names = model.predict_labels(labelled.drop("sentiment"))
    assert {r.predicted_label for r in names.collect()} == {"negative", "neutral", "positive"}


@pytest.mark.parametrize("leak_free", [False, True])
def test_train_and_evaluate(spark, make_comments, leak_free):
    texts = {
        "amazing": "amazing excellent wonderful movie scenes",
        "plain": "plain description without opinion today",
        "awful": "awful horrible terrible movie scenes",
    }
    rows = [{"text": f"{t} number{i}"} for i in range(30) for t in texts.values()]
    processed = materialize(preprocess(make_comments(rows)), "processed")
    run = train_and_evaluate(processed, max_features=50, leak_free=leak_free, max_iterations=20)
    names = set(run.model.standardizer.means)
    assert ("sentiment_score" in names) is not leak_free
    report = {r.row: r for r in run.report.collect()}
    assert report["accuracy"].f1_score == 1.0 and report["accuracy"].support == 18
    assert [r.predicted_negative + r.predicted_neutral + r.predicted_positive for r in run.matrix.collect()] == [6, 6, 6]


def test_lexicon_scorer_and_blank_texts(spark):
    df = spark.createDataFrame([("amazing work",), ("  ",), ("plain",), ("awful",), (None,)], "text string")
    rows = S.predict_texts(df).collect()
    assert [r.sentiment for r in rows] == ["positive", None, "neutral", "negative", None]
    assert [r.reject_reason for r in rows] == [None, "empty_text", None, None, "empty_text"]
    assert rows[0].confidence == max(rows[0].probabilities.values())


def test_outside_model_as_scorer(spark):
    def load():
        def predict(texts):
            good = texts.str.contains("great").astype(float)
            return pd.DataFrame({"negative": 0 * good, "neutral": 1 - good, "positive": good})

        return predict

    df = spark.createDataFrame([("This is great!",), ("This is normal",)], "text string")
    rows = S.pandas_scorer(load)(df, "text").collect()
    assert [(r.sentiment, r.confidence) for r in rows] == [("positive", 1.0), ("neutral", 1.0)]


def test_model_as_scorer(spark, labelled):
    model = M.train_model(labelled, columns=["score_log"], vectors=())
    scorer = S.model_scorer(
        lambda df, text: model.features(df.withColumn("score_log", F.length(text).cast("double"))), model.classifier
    )
    row = scorer(spark.createDataFrame([("xx",)], "text string"), "text").first()
    assert row.sentiment == "positive" and set(row.probabilities) == {"negative", "neutral", "positive"}
