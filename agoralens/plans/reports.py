"""Community, author, trend and thread reports.

Each report is a set of small tables, one per section, over one subject or over
all of them at once.  Comments are scored once and written down, because several
sections read them.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import thread_reference
from ..functions.wordlists import LABELS
from ..operators import aggregates as A
from ..operators.filters import keyword_mentions, long_comments, newest_comments, top_posts
from ..operators.lookups import first_comments
from ..operators.ranking import join_null_safe
from ..operators.requests import MAX_COMMENTS, MAX_COMMUNITIES, MAX_KEYWORD, MAX_POSTS
from ..operators.scoring import Scorer, lexicon_scorer
from ..session import materialize

EMPTY = "No comments found for analysis"


@dataclass(frozen=True)
class Report:
    """Sections by name; ``summary`` has one row per subject, also for an empty one."""

    summary: DataFrame
    sections: dict[str, DataFrame]

    def as_json(self) -> dict[str, DataFrame]:
        """Every section with its rows as JSON strings."""
        return {
            name: df.select(F.to_json(F.struct(*df.columns)).alias("json"))
            for name, df in {"summary": self.summary, **self.sections}.items()
        }


def _check_limit(limit: int, most: int) -> None:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}, not {limit}")


def community_comments(
    comments: DataFrame,
    posts: DataFrame,
    as_of: datetime | str,
    community: str | None = None,
    period: str = "week",
    post_limit: int = 100,
    scorer: Scorer = lexicon_scorer,
) -> DataFrame:
    """Scored comments under the top posts of the period."""
    _check_limit(post_limit, MAX_POSTS)
    chosen = top_posts(posts, period, post_limit, as_of, community)
    chosen = chosen.select("post_id", F.col("subreddit").alias("_community"), F.col("title").alias("post_title"))
    # For one community at most 500 rows.  Otherwise written down, so that the planner
    # knows the size and shuffles the comments only if it must.
    chosen = F.broadcast(chosen) if community is not None else materialize(chosen, "posts")
    rows = long_comments(comments).join(chosen, "post_id").drop("subreddit")
    return scorer(rows.withColumnRenamed("_community", "subreddit"), "text")


def community_report(
    comments: DataFrame,
    posts: DataFrame,
    as_of: datetime | str,
    community: str | None = None,
    period: str = "week",
    post_limit: int = 100,
    scorer: Scorer = lexicon_scorer,
) -> Report:
    """Distribution, daily counts, first titles and top comments per community."""
    scored = materialize(
        community_comments(comments, posts, as_of, community, period, post_limit, scorer), "community"
    )
    by = ["subreddit"]
    if community is not None:
        subjects = comments.sparkSession.range(1).select(F.lit(community).alias("subreddit"))
    else:
        subjects = posts.select("subreddit").distinct()
    return Report(
        _summary(subjects, scored, "subreddit").withColumn("analysis_period", F.lit(period)),
        {
            "sentiment_distribution": A.distribution(scored, by),
            "daily_trends": A.daily_counts(scored, by),
            "first_titles": A.first_titles(scored, by),
            "sample_comments": A.top_comments(scored, by).select(
                "subreddit", "rank", "text", "sentiment", "confidence", "score"
            ),
        },
    )


def author_comments(
    comments: DataFrame, author: str | None = None, limit: int = 50, scorer: Scorer = lexicon_scorer
) -> DataFrame:
    """Scored comments among the newest ones; the limit comes before the length filter."""
    _check_limit(limit, MAX_COMMENTS)
    return scorer(long_comments(newest_comments(comments, limit, author)), "text")


def author_report(
    comments: DataFrame, author: str | None = None, limit: int = 50, scorer: Scorer = lexicon_scorer
) -> Report:
    """Distribution, communities, daily counts and most recent comments per author."""
    scored = materialize(author_comments(comments, author, limit, scorer), "author")
    by = ["author"]
    if author is not None:
        subjects = comments.sparkSession.range(1).select(F.lit(author).alias("author"))
    else:
        subjects = comments.select("author").distinct()
    return Report(
        _summary(subjects, scored, "author"),
        {
            "sentiment_distribution": A.seen_distribution(scored, by),
            "most_active_communities": A.most_active_communities(scored, by),
            "sentiment_over_time": A.daily_counts(scored, by),
            "recent_comments": A.recent_comments(scored, by).select(
                "author", "rank", "text", "sentiment", "confidence", "subreddit", "score", "created_utc"
            ),
        },
    )


def trend_comments(
    comments: DataFrame,
    posts: DataFrame,
    keyword: str,
    as_of: datetime | str,
    communities: list[str] | None = None,
    period: str = "week",
    limit: int = 100,
    scorer: Scorer = lexicon_scorer,
) -> DataFrame:
    """Scored mentions of the keyword under each community's top posts of the period."""
    _check_limit(limit, MAX_POSTS)
    if not 1 <= len(keyword) <= MAX_KEYWORD:
        raise ValueError(f"the keyword has 1 to {MAX_KEYWORD} characters")
    if communities is not None:
        if not 1 <= len(communities) <= MAX_COMMUNITIES:
            raise ValueError(f"1 to {MAX_COMMUNITIES} communities, or none for all")
        posts = posts.filter(F.col("subreddit").isin(communities))
    chosen = top_posts(posts, period, limit, as_of).select(
        "post_id", F.col("subreddit").alias("_community"), F.col("title").alias("post_title")
    )
    # For named communities at most 5 times 500 rows.
    chosen = F.broadcast(chosen) if communities is not None else materialize(chosen, "posts")
    found = keyword_mentions(comments, keyword).join(chosen, "post_id").drop("subreddit")
    return scorer(found.withColumnRenamed("_community", "subreddit"), "text")


def trend_report(
    comments: DataFrame,
    posts: DataFrame,
    keyword: str,
    as_of: datetime | str,
    communities: list[str] | None = None,
    period: str = "week",
    limit: int = 100,
    scorer: Scorer = lexicon_scorer,
) -> Report:
    """Labels and engagement per community, and the best-scored mentions over all."""
    scored = materialize(
        trend_comments(comments, posts, keyword, as_of, communities, period, limit, scorer), "trend"
    )
    total = F.count(F.lit(1))
    summary = scored.agg(
        F.lit(keyword).alias("keyword"),
        total.alias("total_mentions"),
        F.when(total == 0, F.lit(f"No mentions found for '{keyword}' in specified subreddits")).alias("message"),
    )
    return Report(
        summary,
        {
            "sentiment_distribution": A.labels_by(scored),
            "engagement_metrics": A.engagement(scored),
            "sample_mentions": A.top_comments(scored).select(
                "text", "sentiment", "confidence", "score", "subreddit", "created_utc"
            ),
        },
    )


def _summary(subjects: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    counts = scored.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return join_null_safe(subjects, counts, [key], "left").select(
        key,
        F.coalesce("n", F.lit(0)).alias("total_comments_analyzed"),
        F.when(F.col("n").isNull(), F.lit(EMPTY)).alias("message"),
    )


def thread_references(urls: DataFrame, url: str = "url") -> DataFrame:
    """Post and comment id of every URL, or the reason it has none."""
    return urls.withColumn("_ref", thread_reference(F.col(url))).select(
        *urls.columns, "_ref.post_id", "_ref.comment_id", F.col("_ref.reason").alias("reject_reason")
    )


def thread_comments(
    comments: DataFrame, first: int = 20, scorer: Scorer = lexicon_scorer
) -> DataFrame:
    """Scored comments that a thread report lists: the first of each post, then the long ones."""
    return scorer(long_comments(first_comments(comments, first)), "text")


def thread_report(
    urls: DataFrame,
    comments: DataFrame,
    posts: DataFrame,
    url: str = "url",
    first: int = 20,
    scorer: Scorer = lexicon_scorer,
) -> DataFrame:
    """One row per URL: the post's own sentiment and the label counts of its comments.

    A URL that names a comment is about that comment alone, without the length
    filter.  Only posts and comments that some URL names are scored, each once; a
    post named by many URLs adds no work.  URLs that name nothing keep their reason
    and stay out of the joins, where they would all share the null key.
    """
    referenced = materialize(thread_references(urls, url), "references")
    valid = referenced.filter("reject_reason is null").drop("reject_reason")
    rejected = referenced.filter("reject_reason is not null")
    to_thread, to_comment = valid.filter("comment_id is null"), valid.filter("comment_id is not null")

    threads = (
        thread_comments(_only(comments, to_thread, "post_id"), first, scorer)
        .groupBy("post_id")
        .agg(F.count(F.lit(1)).alias("comments_analyzed"), *A.label_counts())
    )
    singles = scorer(_only(comments, to_comment, "comment_id").select("comment_id", "text"), "text").select(
        "comment_id",
        F.lit(1).cast("bigint").alias("comments_analyzed"),
        *[F.when(F.col("sentiment") == s, 1).otherwise(0).cast("bigint").alias(s) for s in LABELS],
    )
    # A thread without long comments counts zero; a comment that is missing is an error.
    counted = (
        to_thread.join(threads, "post_id", "left").fillna(0, ["comments_analyzed", *LABELS])
    ).unionByName(to_comment.join(singles, "comment_id", "left"))

    text = F.when(F.coalesce(F.length("selftext"), F.lit(0)) > 0, F.col("selftext")).otherwise(F.col("title"))
    named = _only(posts, valid, "post_id").withColumn("_text", text)
    scored_posts = scorer(named, "_text").select(
        "post_id",
        F.col("title").alias("post_title"),
        F.col("sentiment").alias("post_sentiment"),
        F.col("confidence").alias("post_confidence"),
        F.col("score").alias("post_score"),
        "upvote_ratio",
    )
    found = counted.join(scored_posts, "post_id", "left").withColumn(
        "reject_reason",
        F.when(F.col("post_title").isNull(), "post_not_found").when(
            F.col("comments_analyzed").isNull(), "comment_not_found"
        ),
    )
    shares = {
        f"{s}_percentage": F.when(F.col("comments_analyzed") > 0, A.percent(F.col(s), F.col("comments_analyzed")))
        for s in LABELS
    }
    reported = found.withColumns(shares).select(
        *urls.columns, "post_id", "comment_id", "reject_reason", "post_title", "post_sentiment", "post_confidence",
        "post_score", "upvote_ratio", "comments_analyzed", *LABELS, *shares,
    )
    return reported.unionByName(rejected, allowMissingColumns=True)


def _only(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows that the other table names."""
    return df.join(wanted.select(key).distinct(), key, "left_semi")


__all__ = [
    "Report",
    "author_comments",
    "author_report",
    "community_comments",
    "community_report",
    "thread_comments",
    "thread_references",
    "thread_report",
    "trend_comments",
    "trend_report",
]
