import math
from datetime import datetime
from glob import glob

import pytest
from pyspark.sql import functions as F

from agoralens.operators import features as Fe
from agoralens.plans.engineer import engineer_features
from agoralens.plans.preprocess import preprocess
from agoralens.streaming import streams


def test_preprocess_keeps_long_texts_and_adds_columns(spark, make_comments):
    df = preprocess(make_comments([{"text": ""}, {"text": "This is a valid test text"}, {"text": "A"}, {"text": None}]))
    (row,) = df.collect()
    assert row.text == "This is a valid test text"
    assert row.cleaned_text == "this is a valid test text"
    assert row.processed_text == "valid test text"
    assert (row.text_length, row.word_count, row.hour, row.day_of_week) == (25, 3, 0, 0)
    assert row.avg_word_length == pytest.approx(20 / 6)
    assert row.is_controversial == 0


def test_monday_is_zero(spark, make_comments):
    rows = [{"text": "one two three four", "created_utc": datetime(2024, 1, d, 13)} for d in (1, 6, 7)]
    got = {r.created_utc.day: (r.day_of_week, r.hour) for r in preprocess(make_comments(rows)).collect()}
    assert got == {1: (0, 13), 6: (5, 13), 7: (6, 13)}


def test_preprocess_refuses_missing_columns(spark):
    with pytest.raises(ValueError, match="missing columns"):
        preprocess(spark.createDataFrame([("test",)], "wrong_column string"))


def test_optional_columns_may_be_absent(spark):
    df = preprocess(spark.createDataFrame([("one two three", 1, "x")], "text string, score int, subreddit string"))
    assert not {"hour", "day_of_week", "is_controversial"} & set(df.columns)
    assert df.count() == 1


def test_texts_are_cleaned_once(spark, make_comments):
    plan = preprocess(make_comments([{}]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("http[^") == 1


def test_text_features(spark):
    df = spark.createDataFrame(
        [("Test!? OK; É:", "test ok", 4), ("", "", 0)], "text string, processed_text string, text_length int"
    )
    a, b = Fe.add_text_features(df).collect()
    assert (a.exclamation_count, a.question_count, a.punctuation_count, a.caps_count) == (1, 1, 4, 4)
    assert a.caps_ratio == 1.0 and a.avg_word_length == 3.0
    assert b.caps_ratio is None and b.avg_word_length is None
    assert Fe.add_text_features(df.drop("text_length")).first().caps_ratio == 0


def test_engagement_features(spark):
    df = spark.createDataFrame([(1, 12, 1), (-1, 18, 5), (0, 0, 0)], "score int, hour int, day_of_week int")
    rows = Fe.add_engagement_features(df).collect()
    assert [r.score_log for r in rows] == pytest.approx([math.log(2), -math.log(2), 0])
    assert rows[1].hour_sin == pytest.approx(-1) and rows[0].hour_cos == pytest.approx(-1)
    assert rows[1].weekday_sin == pytest.approx(math.sin(2 * math.pi * 5 / 7))
    bare = Fe.add_engagement_features(df.select("score")).first()
    assert (bare.hour_sin, bare.weekday_cos) == (0, 0)


def test_sentiment_features(spark):
    df = spark.createDataFrame([(1.0, -1.0), (3.0, 3.0)], "sentiment_strength double, sentiment_score double")
    rows = Fe.add_sentiment_features(df).collect()
    assert [r.sentiment_strength_normalized for r in rows] == [-1.0, 1.0]
    assert [r.sentiment_confidence for r in rows] == [1.0, 3.0]
    flat = Fe.add_sentiment_features(spark.createDataFrame([(0.8, 0.8), (0.8, -0.8)], df.schema)).collect()
    assert [r.sentiment_strength_normalized for r in flat] == [0, 0]


def test_empty_input_gives_empty_output_with_columns(spark):
    df = spark.createDataFrame(
        [], "text string, processed_text string, score double, sentiment_strength double, sentiment_score double"
    )
    out, model = engineer_features(df)
    assert model is None and out.count() == 0 and "sentiment_strength_normalized" in out.columns


def test_engineered_columns(spark):
    df = spark.createDataFrame(
        [
            ("1", "Test text one", "test text one", 1, 12, 1, 12, "positive", 0.8, 0.8),
            ("2", "Test text two", "test text two", -1, 18, 5, 12, "negative", -0.8, 0.8),
            ("3", "Test text six", "test text six", 0, 18, 5, 12, "neutral", 0.1, 0.1),
        ],
        "comment_id string, text string, processed_text string, score int, hour int, day_of_week int, text_length int,"
        " sentiment string, sentiment_score double, sentiment_strength double",
    )
    out, model = engineer_features(df, max_features=4, wide=True)
    assert {"exclamation_count", "caps_ratio", "score_log", "sentiment_confidence", "tfidf_0", "tfidf_2"} <= set(out.columns)
    assert out.count() == 3 and model.terms == ["test", "test text", "text"]
    sparse, _ = engineer_features(df, max_features=4)
    norm = sparse.select(F.col("tfidf")).first().tfidf.norm(2)
    assert norm == pytest.approx(1)


def test_preprocess_with_a_table_of_lemmas(spark, make_comments, tmp_path):
    rows = [{"text": "Cats saw issues and dogs cats"}, {"comment_id": None, "text": "cats mice dogs"}, {"text": "the"}]
    comments = make_comments(rows + rows[:1])
    table = [("cats", "feline"), ("cats", "cat"), ("dogs", "dog"), ("mice", None), (None, "x"), ("issues", "issue")]
    lemmas = spark.createDataFrame(table, "surface string, lemma string")
    found = preprocess(comments, lemmas=lemmas)
    want = preprocess(comments, lemmas={"cats": "cat", "dogs": "dog", "issues": "issue"})
    assert found.columns == want.columns and sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    assert "cat mice dog" in {r.processed_text for r in found.collect()}
    stream = streams.read_stream(spark, _written(comments, f"{tmp_path}/in"), comments.schema)
    with pytest.raises(ValueError, match="features_to_table"):
        preprocess(stream, lemmas=lemmas)
    streams.features_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/state", lemmas=lemmas).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def _written(df, path):
    df.write.parquet(path)
    return path


def test_lemma_lookup_keeps_each_text_once(spark, make_comments):
    # Token arrays are derived again: neither the rows at rest nor the shuffled ones hold them.
    comments = make_comments([{"text": f"the cats of house {i} and the dogs met"} for i in range(20)])
    lemmas = spark.createDataFrame([("cats", "cat"), ("dogs", "dog")], "surface string, lemma string")
    path = f"{spark.conf.get('spark.checkpoint.dir')}/agoralens-{spark.sparkContext.applicationId}/tokens-*"
    before = set(glob(path))
    found = preprocess(comments, lemmas=lemmas)
    assert {r.processed_text for r in found.collect()} == {f"cat house {i} dog met" for i in range(20)}
    (rest,) = set(glob(path)) - before
    rows = spark.read.parquet(rest)
    assert set(rows.columns) == {*comments.columns, "cleaned_text", "_row"}
    assert all(".zstd." in name for name in glob(f"{rest}/part-*"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_words" not in plan.split("Join LeftOuter", 1)[1]


def test_mean_word_length_of_any_spaces(spark):
    texts = ["one three", "é 😀😀", " a bc", "a bc ", "a  bc", "a\tbc d", "a\u00a0bc", "a\u2028bc d", "a\nbc\n", "one", "", " ", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = df.select("i", Fe.mean_word_length(F.col("text")).alias("m")).orderBy("i").collect()
    words = [(t or "").split() for t in texts]
    want = [sum(map(len, w)) / len(w) if w else None for w in words]
    assert [r.m for r in rows] == want
