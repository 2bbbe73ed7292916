"""Counts, distributions and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import preview
from ..functions.wordlists import LABELS
from ..session import materialize
from .quantiles import exact_percentiles
from .ranking import first_n, first_n_per_key, join_null_safe


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc(column))


def distinct_count(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.agg(F.count_distinct(column).alias(name))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of each column.

    Quartiles are exact, with linear interpolation.  Nulls and NaNs are left out of all.
    """
    long = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))
    )
    long = materialize(long.withColumn("value", F.nullif("value", F.lit(float("nan")))), "describe")
    moments = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_percentiles(long, ["column"], "value", [0.25, 0.5, 0.75])
    return join_null_safe(moments, quartiles, ["column"], "left").select(
        "column", "count", "mean", "std", "min", F.col("p_0_25").alias("p25"), F.col("p_0_5").alias("p50"),
        F.col("p_0_75").alias("p75"), "max",
    )


def mean_by(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(column).alias(name))


def label_counts() -> list[Column]:
    """One count per label, zeros kept."""
    return [F.count_if(F.col("sentiment") == name).alias(name) for name in LABELS]


def percent(part: Column, total: Column) -> Column:
    """Rounded half to even, as two decimals; zero when the total is."""
    return F.coalesce(F.bround(F.try_divide(part * F.lit(100.0), total), 2), F.lit(0.0))


def distribution(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All three labels per key with count, ratio and percentage; zeros kept."""
    counts = df.groupBy(*keys).agg(*label_counts(), F.count(F.lit(1)).alias("total"))
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("sentiment"),
                F.col(name).alias("count"),
                F.coalesce(F.try_divide(F.col(name), F.col("total")), F.lit(0.0)).alias("ratio"),
                percent(F.col(name), F.col("total")).alias("percentage"),
            )
            for name in LABELS
        ]
    )
    return counts.select(*keys, "total", F.inline(rows))


def seen_distribution(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The same for the labels that occur."""
    return distribution(df, keys).filter("count > 0")


def daily_counts(df: DataFrame, keys: Sequence[str] = (), at: str = "created_utc") -> DataFrame:
    """Labels per UTC day; only days with rows."""
    return df.groupBy(*keys, F.to_date(at).alias("day")).agg(*label_counts())


def first_titles(df: DataFrame, keys: Sequence[str] = (), n: int = 5) -> DataFrame:
    """Label counts of the first post titles in title order."""
    titles = df.groupBy(*keys, "post_title").agg(*label_counts())
    order = [F.asc("post_title")]
    return first_n_per_key(titles, keys, order, n, salts=1) if keys else first_n(titles, order, n)


def top_comments(df: DataFrame, keys: Sequence[str] = (), n: int = 5) -> DataFrame:
    """The best-scored comments, with a preview of the text."""
    order = [F.desc("score"), F.asc("comment_id")]
    top = first_n_per_key(df, keys, order, n) if keys else first_n(df, order, n)
    return top.withColumn("text", preview(F.col("text")))


def recent_comments(df: DataFrame, keys: Sequence[str] = (), n: int = 5) -> DataFrame:
    order = [F.desc("created_utc"), F.asc("comment_id")]
    return first_n_per_key(df, keys, order, n) if keys else first_n(df, order, n)


def most_active_communities(df: DataFrame, keys: Sequence[str] = (), n: int = 5) -> DataFrame:
    """Communities with the most comments."""
    counts = df.groupBy(*keys, "subreddit").agg(F.count(F.lit(1)).alias("count"))
    order = [F.desc("count"), F.asc("subreddit")]
    return first_n_per_key(counts, keys, order, n, salts=1) if keys else first_n(counts, order, n)


def engagement(df: DataFrame, keys: Sequence[str] = ("subreddit",)) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg("score").alias("avg_score"),
        F.sum("score").alias("total_score"),
        F.count(F.lit(1)).alias("comment_count"),
    )


def labels_by(df: DataFrame, keys: Sequence[str] = ("subreddit",)) -> DataFrame:
    return df.groupBy(*keys).agg(*label_counts())
