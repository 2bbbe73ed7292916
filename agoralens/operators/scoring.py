"""Scorers: text in, label, confidence and probabilities out.

A scorer is a function ``(DataFrame, text column name) -> DataFrame`` that adds
the columns of a prediction record.  Reports take one as an argument.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import label_of, lexicon_score, probabilities_of
from ..functions.wordlists import LABELS
from ..functions.text import SPACE

Scorer = Callable[[DataFrame, str], DataFrame]


def _labels() -> Column:
    return F.array(*[F.lit(name) for name in LABELS])


def add_record(df: DataFrame, probabilities: str, sentiment: Column | None = None) -> DataFrame:
    """Turn an array of class probabilities into sentiment, confidence and a map."""
    best = F.array_position(probabilities, F.array_max(probabilities)).cast("int")
    return df.withColumns(
        {
            "sentiment": sentiment if sentiment is not None else F.element_at(_labels(), best),
            "confidence": F.array_max(probabilities),
            "probabilities": F.map_from_arrays(_labels(), F.col(probabilities)),
        }
    ).drop(probabilities)


def lexicon_scorer(df: DataFrame, text: str = "text") -> DataFrame:
    """The default: the word-list score of the text alone.

    Labels are cut as in weak labelling; probabilities are a softmax whose largest
    entry agrees with the cuts.
    """
    scored = df.withColumn("_s", lexicon_score(F.col(text)))
    scored = scored.withColumn("_p", F.array(*probabilities_of(F.col("_s"))))
    return add_record(scored, "_p", label_of(F.col("_s"))).drop("_s")


def model_scorer(prepare: Callable[[DataFrame, str], DataFrame], model) -> Scorer:
    """A fitted Spark ML classifier; ``prepare`` adds its feature vector."""

    def score(df: DataFrame, text: str = "text") -> DataFrame:
        scored = model.transform(prepare(df, text)).withColumn("_p", vector_to_array("probability"))
        return add_record(scored, "_p").select(*df.columns, "sentiment", "confidence", "probabilities")

    return score


def pandas_scorer(load: Callable[[], Callable[[pd.Series], pd.DataFrame]]) -> Scorer:
    """A model from outside Spark, applied to Arrow batches.

    ``load`` runs once per task and returns a function from a series of texts to a
    frame with one probability column per class.
    """

    @F.pandas_udf("array<double>")
    def probabilities(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = load()
        for texts in batches:
            yield pd.Series(predict(texts).to_numpy(dtype="float64").tolist())

    def score(df: DataFrame, text: str = "text") -> DataFrame:
        return add_record(df.withColumn("_p", probabilities(F.col(text))), "_p")

    return score


def predict_texts(texts: DataFrame, scorer: Scorer = lexicon_scorer, text: str = "text") -> DataFrame:
    """Score a table of texts; blank texts are refused, as ``reject_reason`` says."""
    blank = F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"[{SPACE}]+", "")) == 0
    scored = scorer(texts.withColumn("_blank", blank), text)
    refused = F.col("_blank")
    return scored.withColumns(
        {
            "sentiment": F.when(~refused, F.col("sentiment")),
            "confidence": F.when(~refused, F.col("confidence")),
            "probabilities": F.when(~refused, F.col("probabilities")),
            "reject_reason": F.when(refused, "empty_text"),
        }
    ).drop("_blank")


__all__ = [
    "Scorer",
    "add_record",
    "lexicon_scorer",
    "model_scorer",
    "pandas_scorer",
    "predict_texts",
]
