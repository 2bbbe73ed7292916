"""Weak sentiment labels and the text-only scorer, as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import wordlists as W
from .text import SPACE, let, string_array

WEIGHTED_WORDS = [
    (W.POSITIVE_STRONG, 2),
    (W.POSITIVE_MODERATE, 1),
    (W.NEGATIVE_STRONG, -2),
    (W.NEGATIVE_MODERATE, -1),
]
WEIGHTED_ESTIMATE_WORDS = [
    (W.ESTIMATE_POSITIVE_STRONG, 2),
    (W.ESTIMATE_POSITIVE_MODERATE, 1),
    (W.ESTIMATE_NEGATIVE_STRONG, -2),
    (W.ESTIMATE_NEGATIVE_MODERATE, -1),
]


def lexicon_score(text: Column) -> Column:
    """Sum of the weights of the listed words found anywhere in the text.

    Every word counts once and matches as a substring, so ``thanks`` also counts
    ``thank``.
    """

    def score(low: Column) -> Column:
        found = [
            F.size(F.filter(string_array(words), lambda w: F.contains(low, w))) * weight
            for words, weight in WEIGHTED_WORDS
        ]
        return reduce(add, found)

    return let(F.lower(F.coalesce(text, F.lit(""))), score)


def vote_signal(score: Column) -> Column:
    return F.tanh(score / F.lit(10.0))


def community_category(community: Column, groups: dict[str, list[str]] = W.COMMUNITY_PRIORS) -> Column:
    """Category of a community by a constant list; names are case-sensitive."""
    chosen = F.lit(None).cast("string")
    for category, names in groups.items():
        chosen = F.when(community.isin(names), F.lit(category)).otherwise(chosen)
    return chosen


def community_prior(community: Column) -> Column:
    category = community_category(community)
    return F.when(category == "positive", 0.5).when(category == "negative", -0.5).otherwise(0.0)


def controversy_penalty(controversiality: Column) -> Column:
    return F.when(F.coalesce(controversiality, F.lit(0)) > 0, -1).otherwise(0)


def label_of(sentiment_score: Column) -> Column:
    """Cut at -1 and 1, both bounds closed on the right; a null score has no label."""
    return let(
        sentiment_score,
        lambda s: F.when(s <= -1, "negative").when(s <= 1, "neutral").when(s > 1, "positive"),
    )


def label_id(label: Column) -> Column:
    return F.when(label == "negative", 0).when(label == "neutral", 1).when(label == "positive", 2)


def label_name(label: Column) -> Column:
    return F.when(label == 0, "negative").when(label == 1, "neutral").when(label == 2, "positive")


def estimated_score(text: Column, score: Column, controversiality: Column) -> Column:
    """Score used while collecting: whole-token matches, clipped votes, controversy."""

    def weigh(found: Column) -> Column:
        hits = [
            F.size(F.array_intersect(found, string_array(words))) * F.lit(float(weight))
            for words, weight in WEIGHTED_ESTIMATE_WORDS
        ]
        return reduce(add, hits)

    words = F.split(F.lower(F.coalesce(text, F.lit(""))), f"[{SPACE}]+")
    votes = F.greatest(F.least(score, F.lit(10)), F.lit(-10)) / F.lit(10.0)
    heat = F.when(F.coalesce(controversiality, F.lit(0)) > 0, -1.5).otherwise(0.0)
    return let(words, weigh) + votes + heat


def estimated_label(estimate: Column) -> Column:
    return let(
        estimate, lambda s: F.when(s > 2, "positive").when(s < -1, "negative").otherwise("neutral")
    )


def probabilities_of(lexicon: Column) -> list[Column]:
    """Softmax of (-s, 1, s) for negative, neutral, positive."""
    logits = [-lexicon.cast("double"), F.lit(1.0), lexicon.cast("double")]
    top = F.greatest(*logits)
    weights = [F.exp(x - top) for x in logits]
    total = weights[0] + weights[1] + weights[2]
    return [w / total for w in weights]
