import math

import pytest
from pyspark.sql import functions as F

from agoralens.functions import labels as L
from agoralens.operators.labeling import add_label_ids, add_sentiment_labels


def label_rows(spark, rows, columns="text string, score bigint, subreddit string, controversiality int"):
    return add_sentiment_labels(spark.createDataFrame(rows, columns)).collect()


def test_clear_cases(spark):
    rows = label_rows(
        spark,
        [
            ("This is amazing and fantastic!", 10, "UpliftingNews", 0),
            ("This is horrible and terrible!", -10, "rant", 1),
        ],
    )
    assert [r.sentiment for r in rows] == ["positive", "negative"]
    assert rows[0].sentiment_score == pytest.approx(math.tanh(1) + 0.5 + 4)
    assert rows[1].sentiment_score == pytest.approx(-math.tanh(1) - 0.5 - 4 - 1)


def test_words_match_as_substrings_once(spark):
    got = spark.createDataFrame([("thanks thanks",), ("whatever",), ("THANK you",), (None,)], "text string")
    assert [r[0] for r in got.select(L.lexicon_score(F.col("text"))).collect()] == [2, -2, 1, 0]


def test_cuts_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(-1.0,), (-0.999,), (1.0,), (1.0000000000000002,), (None,)], "s double")
    got = [r[0] for r in df.select(L.label_of(F.col("s"))).collect()]
    assert got == ["negative", "neutral", "neutral", "positive", None]


def test_controversiality_may_be_absent_or_null(spark):
    rows = label_rows(spark, [("plain", 0, "python")], "text string, score bigint, subreddit string")
    assert rows[0].sentiment_score == 0
    assert label_rows(spark, [("plain", 0, "python", None)])[0].sentiment_score == 0


def test_community_names_are_case_sensitive(spark):
    rows = label_rows(spark, [("plain", 0, "happy", 0), ("plain", 0, "Happy", 0)])
    assert [r.sentiment_score for r in rows] == [0.5, 0.0]


def test_null_score_has_no_label(spark):
    assert label_rows(spark, [("plain", None, "python", 0)])[0].sentiment is None


def test_label_ids(spark):
    df = add_label_ids(spark.createDataFrame([("negative",), ("neutral",), ("positive",), (None,)], "sentiment string"))
    assert [r.label for r in df.collect()] == [0, 1, 2, None]
    back = df.select(L.label_name(F.col("label")))
    assert [r[0] for r in back.collect()] == ["negative", "neutral", "positive", None]


@pytest.mark.parametrize(
    "text, score, heat, label",
    [
        ("This is amazing and fantastic!", 10, 0, "positive"),
        ("This is terrible and horrible.", -5, 1, "negative"),
        ("amazing amazing", 0, 0, "neutral"),  # one word counts once: 2 is not above 2
        ("fantastic!", 10, 0, "neutral"),  # attached punctuation prevents the match
        ("bad", 0, 0, "neutral"),  # -1 is not below -1
        ("bad", -1, 0, "negative"),
        ("plain", -100, 0, "neutral"),
        ("plain", 0, 1, "negative"),
    ],
)
def test_estimate(spark, text, score, heat, label):
    df = spark.createDataFrame([(text, score, heat)], "text string, score bigint, heat int")
    estimate = L.estimated_score(F.col("text"), F.col("score"), F.col("heat"))
    assert df.select(L.estimated_label(estimate)).first()[0] == label


def test_probabilities_agree_with_the_cuts(spark):
    df = spark.range(-6, 7).select(F.col("id").alias("s"))
    for r in df.select("s", F.array(*L.probabilities_of(F.col("s"))).alias("p"), L.label_of(F.col("s")).alias("l")).collect():
        assert sum(r.p) == pytest.approx(1)
        assert r.p[L.W.LABEL_IDS[r.l]] == max(r.p)
