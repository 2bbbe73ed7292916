from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from agoralens.operators import filters as P
from agoralens.operators import lookups as J
from agoralens.operators import requests as V


def ids(df):
    return sorted(r.comment_id for r in df.collect())


def test_valid_comments(make_comments):
    df = make_comments(
        [{"text": "x" * 29}, {"text": "x" * 30}, {"text": "[deleted]"}, {"text": "[removed]"}, {"text": None}, {"text": "x" * 31}]
    )
    assert ids(P.valid_comments(df)) == ["c1", "c5"]
    assert ids(P.valid_comments(df, 30, strict=True)) == ["c5"]
    assert ids(P.valid_comments(df, 1)) == ["c0", "c1", "c5"]


def test_without_adult_posts(spark, make_comments):
    posts = spark.createDataFrame([("p1", True), ("p2", False)], "post_id string, over_18 boolean")
    df = make_comments([{"post_id": "p1"}, {"post_id": "p2"}, {"post_id": "p3"}])
    assert ids(P.without_adult_posts(df, posts)) == ["c1", "c2"]


def test_periods(spark, make_comments):
    end = datetime(2024, 3, 1)
    ages = [timedelta(minutes=30), timedelta(hours=5), timedelta(days=3), timedelta(days=20), timedelta(days=300), timedelta(days=900)]
    df = make_comments([{"created_utc": end - a} for a in ages] + [{"created_utc": end + timedelta(seconds=1)}])
    counts = {p: P.in_period(df, p, end).count() for p in P.PERIODS}
    assert counts == {"hour": 1, "day": 2, "week": 3, "month": 4, "year": 5, "all": 7}
    east = datetime(2024, 3, 1, 2, tzinfo=timezone(timedelta(hours=2)))
    assert P.in_period(df, "hour", east).count() == 1
    with pytest.raises(ValueError):
        P.in_period(df, "decade", end)


def test_newest_limit_comes_before_the_length_filter(make_comments):
    rows = [{"author": "ann", "created_utc": datetime(2024, 1, d), "text": "short" if d > 3 else "x" * 40} for d in range(1, 6)]
    df = make_comments([*rows, {"author": "bob"}, {"author": None}, {"author": None}])
    one = P.newest_comments(df, 3, "ann")
    assert ids(one) == ["c2", "c3", "c4"]
    assert ids(P.long_comments(one)) == ["c2"]
    assert ids(P.newest_comments(df, 3)) == ["c2", "c3", "c4", "c5", "c6", "c7"]
    assert ids(P.newest_comments(df, 1)) == ["c4", "c5", "c6"]


def test_keyword_ignores_case(make_comments):
    df = make_comments([{"text": "I like PyThOn a lot, really"}, {"text": "python"}, {"text": "nothing to see in here"}])
    assert ids(P.keyword_mentions(df, "PYTHON")) == ["c0"]


def test_join_with_posts(spark, make_comments):
    posts = spark.createDataFrame([("p1", "T", 5)], "post_id string, title string, score int")
    row = J.with_posts(make_comments([{"score": 3}, {"post_id": "other"}]), posts).collect()
    assert [(r.comment_id, r.score, r.post_title, r.post_score) for r in row] == [("c0", 3, "T", 5)]


def test_first_comments_of_each_post(make_comments):
    rows = [{"post_id": p, "created_utc": datetime(2024, 1, 1, h)} for p in ("p1", "p2") for h in (3, 1, 2)]
    assert ids(J.first_comments(make_comments(rows), 2)) == ["c1", "c2", "c4", "c5"]


@pytest.mark.parametrize("fillers", [0, 498, 499, 5000])
def test_lemma_table_of_any_size(spark, fillers):
    df = spark.createDataFrame(
        [("1", "cats saw issues, dogs cats"), ("2", "the"), ("3", ""), ("4", None), (None, "cats"), ("1", "dogs mice")],
        "id string, cleaned_text string",
    )
    rows = [("cats", "feline"), ("cats", "cat"), ("dogs", "dog"), ("dogs", "dog"), ("mice", None), (None, "x"), ("saw", "saw")]
    filler = spark.range(fillers).selectExpr("concat('w', id) as surface", "'x' as lemma")
    table = spark.createDataFrame(rows, "surface string, lemma string").unionByName(filler)
    got = sorted(map(str, [(r.id, r.processed_text) for r in J.lemmatize(df, table).collect()]))
    want = [("1", "cat saw issues, dog cat"), ("2", ""), ("3", ""), ("4", ""), (None, "cat"), ("1", "dog mice")]
    assert got == sorted(map(str, want))
    assert J.lemmatize(df, table.limit(0)).filter("id = '1'").count() == 2


REQUESTS = [
    ({"kind": "predict", "text": "fine"}, []),
    ({"kind": "predict", "text": ""}, ["text_missing"]),
    ({"kind": "predict", "text": None}, ["text_missing"]),
    ({"kind": "predict", "text": " \t "}, ["text_blank"]),
    ({"kind": "predict", "text": "a" * 5000}, []),
    ({"kind": "predict", "text": "a" * 5001}, ["text_too_long"]),
    ({"kind": "predict_batch", "texts": ["a"] * 100}, []),
    ({"kind": "predict_batch", "texts": ["a" * 9000]}, []),
    ({"kind": "predict_batch", "texts": ["a"] * 101}, ["batch_too_large"]),
    ({"kind": "predict_batch", "texts": []}, ["batch_empty"]),
    ({"kind": "predict_batch", "texts": ["a", " "]}, ["text_blank"]),
    ({"kind": "community", "community": "python"}, []),
    ({"kind": "community", "community": "python", "period": "invalid"}, ["bad_period"]),
    ({"kind": "community", "community": "python", "period": "week", "row_limit": 0}, ["bad_limit"]),
    ({"kind": "community", "community": "python", "row_limit": 500}, []),
    ({"kind": "author", "author": "test_user", "row_limit": 201}, ["bad_limit"]),
    ({"kind": "author", "author": "test_user", "row_limit": 200}, []),
    ({"kind": "author"}, ["author_missing"]),
    ({"kind": "trend", "keyword": "k", "communities": []}, ["communities_missing"]),
    ({"kind": "trend", "keyword": "", "communities": ["a"]}, ["keyword_missing"]),
    ({"kind": "trend", "keyword": "k" * 101, "communities": ["a"] * 6}, ["keyword_too_long", "too_many_communities"]),
    ({"kind": "trend", "keyword": "k", "communities": ["a"] * 5, "period": "all"}, []),
    ({"kind": "url", "url": "https://www.reddit.com/r/x/comments/1"}, []),
    ({"kind": "url", "url": "ftp://reddit.com/"}, ["bad_url"]),
    ({"kind": "url"}, ["bad_url"]),
    ({"kind": "other"}, ["unknown_kind"]),
    ({"kind": None}, ["unknown_kind"]),
]


def test_request_rules(spark):
    schema = "n int, " + ", ".join(f"{name} {kind}" for name, kind in V.FIELDS.items())
    rows = [(i, *[r.get(name) for name in V.FIELDS]) for i, (r, _) in enumerate(REQUESTS)]
    df = spark.createDataFrame(rows, schema)
    got = [r.violations for r in V.validate(df).orderBy("n").collect()]
    assert got == [want for _, want in REQUESTS]
    good = sum(not want for _, want in REQUESTS)
    assert (V.accepted(df).count(), V.rejected(df).count()) == (good, len(REQUESTS) - good)


def test_absent_request_fields_count_as_null(spark):
    df = spark.createDataFrame([("predict", "x")], "kind string, text string")
    assert V.validate(df).first().accepted
    assert V.validate(df.select(F.lit("trend").alias("kind"))).first().violations == ["keyword_missing", "communities_missing"]
