from datetime import datetime, timedelta

import pytest

from agoralens.plans import reports as R

NOW = datetime(2024, 2, 1)
LONG = "plain words that are long enough"


@pytest.fixture
def posts(spark):
    rows = [
        ("p1", "python", "B title", "", 10, 0.9, NOW - timedelta(days=1)),
        ("p2", "python", "A title", "awful body", 5, 0.5, NOW - timedelta(days=2)),
        ("p3", "python", "old", "", 99, 0.5, NOW - timedelta(days=20)),
        ("p4", "movies", "film", "", 1, 0.5, NOW - timedelta(hours=5)),
        ("p5", "quiet", "nothing", "", 1, 0.5, NOW - timedelta(hours=5)),
    ]
    return spark.createDataFrame(
        rows, "post_id string, subreddit string, title string, selftext string, score bigint, upvote_ratio double, created_utc timestamp"
    )


@pytest.fixture
def comments(make_comments):
    def row(post, text, score, hours, author="ann", community="python"):
        return {
            "post_id": post, "text": text, "score": score, "created_utc": NOW - timedelta(hours=hours),
            "author": author, "subreddit": community,
        }

    return make_comments(
        [
            row("p1", "amazing " + LONG, 5, 30),
            row("p1", "awful " + LONG + " x" * 200, 9, 30),
            row("p1", "short", 50, 1),
            row("p2", LONG, 1, 2, "bob"),
            row("p3", LONG, 1, 2),
            row("p4", "amazing PYTHON " + LONG, 7, 3, "bob", "movies"),
        ]
    )


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_community_report(comments, posts):
    report = R.community_report(comments, posts, NOW, "python", "week", 100)
    assert rows(report.summary, "subreddit", "total_comments_analyzed", "message") == [("python", 3, None)]
    assert rows(report.sections["sentiment_distribution"], "sentiment", "count", "percentage") == [
        ("negative", 1, 33.33), ("neutral", 1, 33.33), ("positive", 1, 33.33),
    ]
    assert [r.post_title for r in report.sections["first_titles"].orderBy("rank").collect()] == ["A title", "B title"]
    assert len(report.sections["daily_trends"].collect()) == 2
    sample = report.sections["sample_comments"].orderBy("rank").collect()
    assert [r.score for r in sample] == [9, 5, 1] and sample[0].text.endswith("...") and len(sample[0].text) == 203


def test_all_communities_at_once_with_empty_ones(comments, posts):
    report = R.community_report(comments, posts, NOW, period="week", post_limit=1)
    assert rows(report.summary, "subreddit", "total_comments_analyzed", "message") == [
        ("movies", 1, None), ("python", 2, None), ("quiet", 0, R.EMPTY),
    ]
    none = R.community_report(comments, posts, NOW, "quiet").summary.first()
    assert (none.total_comments_analyzed, none.message) == (0, R.EMPTY)


def test_limits_are_checked(comments, posts):
    for limit in (0, 501):
        with pytest.raises(ValueError):
            R.community_report(comments, posts, NOW, "python", post_limit=limit)
    with pytest.raises(ValueError):
        R.author_report(comments, "ann", 201)
    with pytest.raises(ValueError):
        R.trend_report(comments, posts, "", NOW)
    with pytest.raises(ValueError):
        R.trend_report(comments, posts, "x", NOW, communities=["a"] * 6)


def test_author_report(comments):
    report = R.author_report(comments, "bob")
    assert report.summary.first().total_comments_analyzed == 2
    assert rows(report.sections["sentiment_distribution"], "sentiment", "count", "percentage") == [
        ("neutral", 1, 50.0), ("positive", 1, 50.0),
    ]
    assert rows(report.sections["most_active_communities"], "subreddit", "count") == [("movies", 1), ("python", 1)]
    recent = report.sections["recent_comments"].orderBy("rank").collect()
    assert [r.subreddit for r in recent] == ["python", "movies"]
    # The newest comment of ann is too short, and the limit counts it.
    assert R.author_report(comments, "ann", 1).summary.first().total_comments_analyzed == 0
    both = R.author_report(comments, limit=1).summary
    assert rows(both, "author", "total_comments_analyzed") == [("ann", 0), ("bob", 1)]


def test_trend_report(comments, posts):
    report = R.trend_report(comments, posts, "python", NOW, ["python", "movies"])
    assert report.summary.first().total_mentions == 1
    assert rows(report.sections["sentiment_distribution"], "subreddit", "positive") == [("movies", 1)]
    assert rows(report.sections["engagement_metrics"], "avg_score", "total_score", "comment_count") == [(7.0, 7, 1)]
    nothing = R.trend_report(comments, posts, "absent", NOW).summary.first()
    assert nothing.total_mentions == 0 and "absent" in nothing.message


def test_thread_report(spark, comments, posts):
    site = "https://reddit.com/r/x/comments"
    urls = [f"{site}/p1/t/", f"{site}/p2/t/c2", f"{site}/p9/t/", f"{site}/p1/t/c99", "https://example.com/", f"{site}/p5"]
    df = spark.createDataFrame(list(enumerate(urls)), "n int, url string")
    got = {r.n: r for r in R.thread_report(df, comments, posts).collect()}
    assert len(got) == 6
    first = got[0]
    assert (first.post_title, first.post_sentiment, first.comments_analyzed) == ("B title", "neutral", 2)
    assert (first.negative, first.positive, first.positive_percentage) == (1, 1, 50.0)
    # A comment is reported however short it is; the post's text is its body.
    assert (got[1].post_sentiment, got[1].comments_analyzed, got[1].neutral) == ("negative", 1, 1)
    assert [got[n].reject_reason for n in (2, 3, 4)] == ["post_not_found", "comment_not_found", "not_a_site_url"]
    assert (got[5].reject_reason, got[5].comments_analyzed, got[5].positive_percentage) == (None, 0, None)
    short = R.thread_report(df, comments, posts, first=1).filter("n = 0").first()
    assert short.comments_analyzed == 1


def test_reports_as_json(comments):
    sections = R.author_report(comments, "bob").as_json()
    assert '"total_comments_analyzed":2' in sections["summary"].first().json


def test_a_missing_author_is_counted(make_comments):
    comments = make_comments([{"author": None}, {"author": None}, {"author": "bob", "text": "short"}])
    got = {r.author: (r.total_comments_analyzed, r.message is None) for r in R.author_report(comments).summary.collect()}
    assert got == {None: (2, True), "bob": (0, False)}
