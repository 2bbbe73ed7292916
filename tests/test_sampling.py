from collections import Counter

import pytest

from agoralens.operators import sampling as B


def table(spark, **sizes):
    rows = [(f"{label}{i}", label) for label, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "comment_id string, sentiment string").repartition(5)


def test_classes_reach_the_mean(spark):
    df = table(spark, positive=100, negative=50, neutral=25, other=40)
    out = B.balance_classes(df, copy_column="copy").collect()
    assert Counter(r.sentiment for r in out) == {"positive": 58, "negative": 58, "neutral": 58}
    large = [r for r in out if r.sentiment == "positive"]
    assert len({r.comment_id for r in large}) == 58 and {r.copy for r in large} == {0}
    small = [r for r in out if r.sentiment == "neutral"]
    assert sorted(r.copy for r in small) == list(range(1, 59))
    assert len({r.comment_id for r in small}) < 25 + 1
    source = {(r.comment_id, r.sentiment) for r in df.collect()}
    assert {(r.comment_id, r.sentiment) for r in out} <= source


def test_balance_is_repeatable_and_depends_on_the_seed(spark):
    df = table(spark, positive=90, negative=30, neutral=30)
    runs = [sorted(map(tuple, B.balance_classes(d, seed=s).collect())) for d, s in ((df, 1), (df.repartition(2), 1), (df, 2))]
    assert runs[0] == runs[1] != runs[2]
    assert B.balance_classes(df).columns == df.columns


def test_other_strategies_change_nothing(spark):
    df = table(spark, positive=3, negative=1)
    assert B.balance_classes(df, "none").count() == 4
    assert B.balance_classes(df.drop("sentiment")).count() == 4


def test_empty_class(spark):
    with pytest.raises(ValueError, match="neutral"):
        B.balance_classes(table(spark, positive=30, negative=30))
    assert B.balance_classes(table(spark, positive=1, negative=1)).count() == 0


def test_one_row_is_drawn_many_times(spark):
    out = B.balance_classes(table(spark, positive=200, negative=99, neutral=1)).collect()
    assert Counter(r.sentiment for r in out) == {"positive": 100, "negative": 100, "neutral": 100}


def test_split_takes_a_share_of_every_class(spark):
    out = B.stratified_split(table(spark, positive=101, negative=50, neutral=3, other=5)).collect()
    assert Counter((r.sentiment, r.split) for r in out) == {
        ("positive", "test"): 20, ("positive", "train"): 81, ("negative", "test"): 10,
        ("negative", "train"): 40, ("neutral", "test"): 1, ("neutral", "train"): 2,
    }
    assert len({r.comment_id for r in out}) == 154


def test_split_without_test_rows(spark):
    out = B.stratified_split(table(spark, positive=10, negative=2), 0.2).collect()
    assert Counter((r.sentiment, r.split) for r in out)[("negative", "train")] == 2
