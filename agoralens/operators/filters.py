"""Row filters over comments and posts."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.wordlists import REMOVED_MARKS
from ..session import materialize
from .ranking import first_n, first_n_by_cutoff, first_n_per_key, newest_first

# The accepted periods and their length.
PERIODS = {
    "hour": "1 hour",
    "day": "1 day",
    "week": "7 days",
    "month": "1 month",
    "year": "1 year",
    "all": None,
}


def valid_comments(comments: DataFrame, min_length: int = 30, strict: bool = False, text: str = "text") -> DataFrame:
    """Comments with a body that is long enough and not a removal mark.

    ``strict`` asks for more than ``min_length`` characters instead of at least.
    """
    size = F.length(text)
    long_enough = size > min_length if strict else size >= min_length
    return comments.filter(long_enough & ~F.col(text).isin(REMOVED_MARKS))


def long_comments(comments: DataFrame, more_than: int = 20, text: str = "text") -> DataFrame:
    """The length filter of the reports."""
    return comments.filter(F.length(text) > more_than)


def without_adult_posts(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """Drop the comments of posts flagged as adult.

    The flagged ids are written down first: the planner then knows their size and, if
    it allows, broadcasts them, so the comments are not shuffled.
    """
    flagged = materialize(posts.filter("over_18").select("post_id"), "flagged")
    return comments.join(flagged, "post_id", "left_anti")


def instant(as_of: datetime | str) -> Column:
    """A UTC instant as a literal; a datetime without a zone counts as UTC."""
    if isinstance(as_of, datetime):
        if as_of.tzinfo is not None:
            as_of = as_of.astimezone(timezone.utc).replace(tzinfo=None)
        as_of = as_of.isoformat(sep=" ")
    return F.lit(f"{as_of}Z").cast("timestamp")


def in_period(df: DataFrame, period: str, as_of: datetime | str, at: str = "created_utc") -> DataFrame:
    """Rows of the period that ends at ``as_of``."""
    if period not in PERIODS:
        raise ValueError(f"unknown period {period!r}; one of {', '.join(PERIODS)}")
    if PERIODS[period] is None:
        return df
    end = instant(as_of)
    return df.filter((F.col(at) >= end - F.expr(f"interval {PERIODS[period]}")) & (F.col(at) <= end))


def top_posts(
    posts: DataFrame, period: str, limit: int, as_of: datetime | str, community: str | None = None
) -> DataFrame:
    """The best-scored posts of the period: of one community, or of every community."""
    recent = in_period(posts, period, as_of)
    order = [F.desc("score"), F.asc("post_id")]
    if community is not None:
        return first_n(recent.filter(F.col("subreddit") == community), order, limit)
    return first_n_per_key(recent, ["subreddit"], order, limit).drop("rank")


def newest_comments(comments: DataFrame, limit: int = 50, author: str | None = None) -> DataFrame:
    """The newest comments of one author, or of every author; limited before any other filter."""
    if author is not None:
        order = [F.desc("created_utc"), F.asc("comment_id")]
        return first_n(comments.filter(F.col("author") == author), order, limit)
    return first_n_by_cutoff(comments, ["author"], newest_first("created_utc", "comment_id"), limit)


def mentions(keyword: str, text: str = "text") -> Column:
    """Whether the text holds the keyword, ignoring case."""
    return F.contains(F.lower(F.col(text)), F.lower(F.lit(keyword)))


def keyword_mentions(comments: DataFrame, keyword: str, more_than: int = 20) -> DataFrame:
    return long_comments(comments, more_than).filter(mentions(keyword))
