"""Collection quotas: rows per community and per estimated class."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import estimated_label, estimated_score
from ..functions.text import string_array, word_count
from ..functions.wordlists import (
    BULK_LIMIT,
    BULK_LISTINGS,
    COLLECTION_GROUPS,
    COLLECTION_LISTINGS,
    LABELS,
)
from ..session import materialize
from .filters import valid_comments, without_adult_posts
from .ranking import first_n_per_key


def _rank_in(column: str, values: list[str]) -> Column:
    """Position in a constant list from 0; null when absent."""
    at = F.array_position(string_array(values), F.col(column))
    return F.when(at > 0, (at - 1).cast("int"))


def distinct_comments(comments: DataFrame, order: Column, *carried: str) -> DataFrame:
    """Per comment its first place in the order, and the carried columns found there.

    Copies are reduced inside each partition before the shuffle, which sees only
    these columns.
    """
    return (
        comments.groupBy("comment_id")
        .agg(F.min(F.struct(order.alias("_at"), *carried)).alias("_first"))
        .select("comment_id", "_first.*")
    )


def rows_at(found: DataFrame) -> DataFrame:
    """One row per comment out of those found at its chosen place.

    Of several rows at one place the smallest is taken, so the result can be repeated.
    """
    one = found.groupBy("comment_id").agg(F.min(F.struct(*[F.col(c) for c in found.columns])).alias("_row"))
    return one.select("_row.*").drop("_at")


def with_estimate(comments: DataFrame) -> DataFrame:
    """Add the estimate made while collecting and the raw text's lengths."""
    heat = F.col("controversiality") if "controversiality" in comments.columns else F.lit(0)
    return comments.withColumns(
        {
            "sentiment": estimated_label(estimated_score(F.col("text"), F.col("score"), heat)),
            "text_length": F.length("text"),
            "word_count": word_count(F.col("text")),
        }
    )


def capped_comments(
    comments: DataFrame,
    posts: DataFrame,
    limit: int = BULK_LIMIT,
    communities: list[str] | None = None,
    listings: list[str] = BULK_LISTINGS,
    min_length: int = 20,
) -> DataFrame:
    """At most ``limit`` comments per community, taken listing by listing.

    Comments of adult posts, removed ones and those of ``min_length`` characters
    or fewer do not count.
    """
    if communities is not None:
        comments = comments.filter(F.col("subreddit").isin(communities))
    rows = without_adult_posts(valid_comments(comments, min_length, strict=True), posts)
    rows = rows.withColumn("_listing", _rank_in("listing", listings)).filter("_listing is not null")
    rows = rows.withColumn("_at", F.struct("_listing", "created_utc", "comment_id")).drop("_listing")
    places = distinct_comments(rows, F.col("_at"), "subreddit")
    chosen = first_n_per_key(places, ["subreddit"], [F.asc("_at")], limit)
    # At rest, so that the planner knows whether it may be broadcast.
    chosen = materialize(chosen.select("comment_id", "_at"), "capped")
    return rows_at(rows.join(chosen, ["comment_id", "_at"]))


def quota_comments(
    comments: DataFrame,
    posts: DataFrame,
    target_per_class: int = 5000,
    max_per_community: int = 1000,
    min_length: int = 30,
    groups: dict[str, list[str]] = COLLECTION_GROUPS,
    listings: dict[str, list[str]] = COLLECTION_LISTINGS,
) -> DataFrame:
    """Comments that a reader accepting rows in arrival order would keep.

    A row is kept while both its class and its community have room.  Arrival
    order: group of communities, community, listing, time, id.

    The outcome equals that of reading one row after the other, found in bulk:

    * Within one community and class the kept rows come first, because a quota
      that is full stays full.  So the first ``min(quota)`` rows of each pair
      are the only candidates; finding them is the one shuffle over the whole
      table, of ids, places and classes.
    * With the moments known at which classes fill up, the kept rows of a
      community are its first rows that are not of a full class.  There are
      three classes, so each round finds the next class to fill up and at most
      three rounds over the candidates are needed.
    """
    names = list(groups)
    group = F.coalesce(*[F.when(F.col("subreddit").isin(groups[g]), F.lit(i)) for i, g in enumerate(names)])
    community_rank = F.coalesce(*[_rank_in("subreddit", groups[g]) for g in names])
    listing_rank = F.coalesce(
        *[F.when(F.col("_group") == i, _rank_in("listing", listings[g])) for i, g in enumerate(names)]
    )
    rows = valid_comments(comments.filter(F.col("subreddit").isin(sum(groups.values(), []))), min_length)
    rows = without_adult_posts(rows, posts).withColumn("_group", group)
    rows = rows.withColumn("_listing", listing_rank).filter("_listing is not null")
    place = F.struct(
        F.col("_group").alias("a"),
        community_rank.alias("b"),
        F.col("_listing").alias("c"),
        F.unix_micros("created_utc").alias("d"),
        F.col("comment_id").alias("e"),
    )
    rows = rows.withColumn("_at", place).drop("_group", "_listing")
    places = distinct_comments(with_estimate(rows), F.col("_at"), "subreddit", "sentiment")
    pair_limit = min(target_per_class, max_per_community)
    candidates = first_n_per_key(places, ["subreddit", "sentiment"], [F.asc("_at")], pair_limit)
    candidates = materialize(candidates, "candidates")

    full_at: dict[str, Column] = {}
    while True:
        kept = _kept(candidates, full_at, max_per_community)
        if len(full_at) == len(LABELS):
            break
        filled = (
            first_n_per_key(
                kept.filter(~F.col("sentiment").isin(list(full_at))), ["sentiment"], [F.asc("_at")], target_per_class
            )
            .filter(F.col("rank") == target_per_class)
            .orderBy("_at")
            .select("sentiment", "_at")
            .first()
        )
        if filled is None:
            break
        full_at[filled.sentiment] = F.struct(
            *[F.lit(filled["_at"][f]).cast(t).alias(f) for f, t in zip("abcde", ("int", "int", "int", "bigint", "string"))]
        )
    chosen = materialize(kept.select("comment_id", "_at", F.col("sentiment").alias("_class")), "quota")
    found = with_estimate(rows.join(chosen, ["comment_id", "_at"]))
    return rows_at(found.filter(F.col("sentiment") == F.col("_class")).drop("_class"))


def _kept(candidates: DataFrame, full_at: dict[str, Column], max_per_community: int) -> DataFrame:
    """First rows per community among those that come before their class is full."""
    late = [(F.col("sentiment") == label) & (F.col("_at") > at) for label, at in full_at.items()]
    open_rows = candidates.filter(~reduce(or_, late)) if late else candidates
    window = Window.partitionBy("subreddit").orderBy("_at")
    return (
        open_rows.withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") <= max_per_community)
        .drop("_rank")
    )
