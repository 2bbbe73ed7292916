"""Weak sentiment labels of comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L


def add_sentiment_labels(comments: DataFrame) -> DataFrame:
    """Add ``sentiment_score`` and ``sentiment`` from words, votes, community and controversy.

    Without a ``controversiality`` column nothing counts as controversial.
    """
    heat = F.col("controversiality") if "controversiality" in comments.columns else F.lit(0)
    signal = (
        L.vote_signal(F.col("score"))
        + L.community_prior(F.col("subreddit"))
        + L.lexicon_score(F.col("text"))
        + L.controversy_penalty(heat)
    )
    return comments.withColumn("sentiment_score", signal).withColumn(
        "sentiment", L.label_of(F.col("sentiment_score"))
    )


def add_label_ids(df: DataFrame, sentiment: str = "sentiment", output: str = "label") -> DataFrame:
    return df.withColumn(output, L.label_id(F.col(sentiment)))
