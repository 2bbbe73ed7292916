"""Validation of request rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE
from .filters import PERIODS

# Request kinds and the bounds of their fields.
KINDS = ["predict", "predict_batch", "community", "author", "url", "trend"]
MAX_TEXT = 5000
MAX_BATCH = 100
MAX_KEYWORD = 100
MAX_COMMUNITIES = 5
MAX_POSTS = 500
MAX_COMMENTS = 200
URL_PATTERN = r"^https?://(?:www\.)?reddit\.com/.*$"

FIELDS = {
    "kind": "string",
    "text": "string",
    "texts": "array<string>",
    "community": "string",
    "communities": "array<string>",
    "author": "string",
    "keyword": "string",
    "url": "string",
    "period": "string",
    "row_limit": "bigint",
}


def _blank(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[{SPACE}]+", "")) == 0


def violations(kind: Column) -> Column:
    """Codes of the rules that a request row breaks, in a fixed order."""

    def col(name):
        return F.col(name)

    period = F.coalesce(col("period"), F.lit("week"))
    posts = F.coalesce(col("row_limit"), F.lit(100))
    comments = F.coalesce(col("row_limit"), F.lit(50))
    n_texts = F.coalesce(F.array_size("texts"), F.lit(0))
    n_communities = F.coalesce(F.array_size("communities"), F.lit(0))
    is_predict, is_batch = kind == "predict", kind == "predict_batch"
    is_community, is_author = kind == "community", kind == "author"
    is_trend, is_url = kind == "trend", kind == "url"
    rules = [
        ("unknown_kind", kind.isNull() | ~kind.isin(KINDS)),
        ("text_missing", is_predict & (F.coalesce(F.length("text"), F.lit(0)) == 0)),
        ("text_too_long", is_predict & (F.length("text") > MAX_TEXT)),
        ("text_blank", is_predict & (F.length("text") > 0) & _blank(col("text"))),
        ("batch_empty", is_batch & (n_texts == 0)),
        ("batch_too_large", is_batch & (n_texts > MAX_BATCH)),
        ("text_blank", is_batch & F.exists(F.coalesce(col("texts"), F.array().cast("array<string>")),
                                           lambda t: t.isNull() | _blank(t))),
        ("community_missing", is_community & col("community").isNull()),
        ("author_missing", is_author & col("author").isNull()),
        ("keyword_missing", is_trend & (F.coalesce(F.length("keyword"), F.lit(0)) == 0)),
        ("keyword_too_long", is_trend & (F.length("keyword") > MAX_KEYWORD)),
        ("communities_missing", is_trend & (n_communities == 0)),
        ("too_many_communities", is_trend & (n_communities > MAX_COMMUNITIES)),
        ("bad_period", (is_community | is_trend) & ~period.isin(list(PERIODS))),
        ("bad_limit", (is_community | is_trend) & ~posts.between(1, MAX_POSTS)),
        ("bad_limit", is_author & ~comments.between(1, MAX_COMMENTS)),
        ("bad_url", is_url & ~F.coalesce(col("url").rlike(URL_PATTERN), F.lit(False))),
    ]
    return F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, broken in rules]))


def validate(requests: DataFrame) -> DataFrame:
    """Add ``violations`` and ``accepted``; fields that are absent count as null."""
    for name, kind in FIELDS.items():
        if name not in requests.columns:
            requests = requests.withColumn(name, F.lit(None).cast(kind))
    return requests.withColumn("violations", violations(F.col("kind"))).withColumn(
        "accepted", F.size("violations") == 0
    )


def accepted(requests: DataFrame) -> DataFrame:
    return validate(requests).filter("accepted").drop("violations", "accepted")


def rejected(requests: DataFrame) -> DataFrame:
    return validate(requests).filter("not accepted").drop("accepted")
