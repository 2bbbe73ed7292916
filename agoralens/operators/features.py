"""Text, time, vote and sentiment features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def mean_word_length(text: Column) -> Column:
    """Mean length of the whitespace-separated words; null for a text without words.

    In words joined by single spaces, as texts are after cleaning, the spaces tell both
    numbers, which is cheaper than matching every word.
    """

    def mean(t: Column) -> Column:
        letters = F.length(F.replace(t, F.lit(" "), F.lit("")))
        joined = letters / (F.length(t) - letters + 1)
        odd = t.rlike(rf"\A(?: |\z)| (?: |\z)|[{T.SPACE}&&[^ ]]")
        return F.when(~odd, joined).otherwise(F.try_divide(T.letter_count(t), T.word_count(t)))

    return T.let(text, mean)


def add_text_features(df: DataFrame) -> DataFrame:
    """Counts on the raw text and the mean word length of the processed one.

    ``caps_ratio`` divides capitals of the raw text by the length of the cleaned
    text; it is null for length 0 and 0 without a length column.
    """
    raw = F.col("text")
    caps = F.regexp_count(F.coalesce(raw, F.lit("")), F.lit(r"\p{IsUppercase}"))
    df = df.withColumns(
        {
            "exclamation_count": F.regexp_count(raw, F.lit("!")),
            "question_count": F.regexp_count(raw, F.lit(r"\?")),
            "punctuation_count": F.regexp_count(raw, F.lit("[.,!?;:]")),
            "caps_count": caps,
            "avg_word_length": mean_word_length(F.col("processed_text")),
        }
    )
    has_length = "text_length" in df.columns
    return df.withColumn(
        "caps_ratio", F.try_divide("caps_count", "text_length") if has_length else F.lit(0.0)
    )


def _cycle(df: DataFrame, column: str, period: int, name: str) -> dict[str, Column]:
    if column not in df.columns:
        return {f"{name}_sin": F.lit(0.0), f"{name}_cos": F.lit(0.0)}
    angle = F.lit(2.0) * F.pi() * F.col(column) / F.lit(float(period))
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def add_engagement_features(df: DataFrame) -> DataFrame:
    """Signed log of the votes; hour and weekday on the unit circle."""
    return df.withColumns(
        {
            "score_log": F.log1p(F.abs("score")) * F.signum("score"),
            **_cycle(df, "hour", 24, "hour"),
            **_cycle(df, "day_of_week", 7, "weekday"),
        }
    )


def add_sentiment_features(df: DataFrame) -> DataFrame:
    """Strength as a z-score over the whole table, and the confidence.

    Mean and population deviation come from a scalar subquery: one pass of partial
    aggregates, and two numbers handed to the second pass.  A deviation of zero
    gives zero.
    """
    moments = df.select(
        F.struct(
            F.avg("sentiment_strength").alias("mean"), F.stddev_pop("sentiment_strength").alias("std")
        ).alias("m")
    )
    m = moments.scalar()
    std = F.when(m["std"] == 0, F.lit(1.0)).otherwise(m["std"])
    return df.withColumns(
        {
            "sentiment_strength_normalized": (F.col("sentiment_strength") - m["mean"]) / std,
            "sentiment_confidence": F.abs("sentiment_score"),
        }
    )
