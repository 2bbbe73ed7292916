"""Preprocessed comments to a balanced table of features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.wordlists import TFIDF_STOP_WORDS
from ..operators.evaluation import classification_report, confusion_matrix
from ..operators.features import add_engagement_features, add_sentiment_features, add_text_features
from ..operators.modeling import SentimentModel, feature_columns, train_model
from ..operators.sampling import SEED, balance_classes, stratified_split
from ..operators.tfidf import MAX_FEATURES, TfidfModel, fit_tfidf, wide_weights
from ..session import materialize


def add_features(df: DataFrame) -> DataFrame:
    """Text, engagement and sentiment features of stage two."""
    return add_sentiment_features(add_engagement_features(add_text_features(df)))


def engineer_features(
    df: DataFrame,
    balance_strategy: str = "hybrid",
    max_features: int = MAX_FEATURES,
    key: str = "comment_id",
    stop_words: list[str] = TFIDF_STOP_WORDS,
    wide: bool = False,
    copy_column: str | None = None,
    seed: int = SEED,
) -> tuple[DataFrame, TfidfModel | None]:
    """All features, TF-IDF as one sparse column, then balanced classes.

    The input is read several times (moments, vocabulary, class counts, cut-offs),
    so it should be a table at rest, not an expensive plan.  An empty input gives
    an empty result.
    """
    featured = add_features(df)
    if df.isEmpty():
        return featured, None
    model = fit_tfidf(df, max_features=max_features, stop_words=stop_words)
    featured = model.transform(featured)
    if wide:
        featured = wide_weights(featured, model)
    return balance_classes(featured, balance_strategy, key=key, copy_column=copy_column, seed=seed), model


@dataclass(frozen=True)
class TrainingRun:
    model: SentimentModel
    tfidf: TfidfModel
    predictions: DataFrame
    report: DataFrame
    matrix: DataFrame


@dataclass(frozen=True)
class TextModel:
    """A classifier of raw texts: vocabulary, weights and coefficients."""

    model: SentimentModel
    tfidf: TfidfModel

    def predict(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Add ``predicted_label``, ``confidence`` and ``probabilities`` of each text."""
        worded = df.withColumn("_words", T.process_text(T.clean_text(F.col(text))))
        scored = self.model.predict(self.tfidf.transform(worded, "_words"))
        return scored.drop("_words", "tfidf")

    def save(self, path: str) -> None:
        self.model.save(f"{path}/classifier")
        self.tfidf.save(f"{path}/tfidf")

    @classmethod
    def load(cls, path: str) -> TextModel:
        return cls(SentimentModel.load(f"{path}/classifier"), TfidfModel.load(f"{path}/tfidf"))


def train_text_model(
    processed: DataFrame, key: str = "comment_id", max_features: int = MAX_FEATURES, seed: int = SEED,
    max_iterations: int = 50,
) -> TextModel:
    """A classifier on the words alone, fitted on balanced classes of preprocessed comments at rest."""
    tfidf = fit_tfidf(processed, max_features=max_features)
    rows = tfidf.transform(processed.select(key, "processed_text", "sentiment"))
    balanced = materialize(balance_classes(rows, "hybrid", key=key, seed=seed), "balanced")
    return TextModel(train_model(balanced, [], max_iterations=max_iterations), tfidf)


def train_and_evaluate(
    processed: DataFrame,
    key: str = "comment_id",
    max_features: int = MAX_FEATURES,
    leak_free: bool = False,
    test_fraction: float = 0.2,
    seed: int = SEED,
    max_iterations: int = 50,
) -> TrainingRun:
    """Fit the classifier and evaluate it on held-out rows.

    By default features and balancing see all rows before the split and the label's
    own score is among the features, as in the workflow this replaces.  With
    ``leak_free`` the split comes first, only training rows are balanced and fitted
    on, and the ``sentiment_`` columns are left out.
    """
    if leak_free:
        parts = materialize(stratified_split(processed, test_fraction, key=key, seed=seed), "split")
        train, test = (parts.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
        train, tfidf = engineer_features(train, max_features=max_features, key=key, seed=seed)
        test = tfidf.transform(add_features(test))
        columns = [c for c in feature_columns(train) if not c.startswith("sentiment_")]
    else:
        featured, tfidf = engineer_features(
            processed, max_features=max_features, key=key, copy_column="_copy", seed=seed
        )
        featured = featured.withColumn("_row", F.concat_ws("#", key, "_copy"))
        parts = materialize(stratified_split(featured, test_fraction, key="_row", seed=seed), "split")
        train, test = (parts.filter(F.col("split") == s).drop("split", "_copy", "_row") for s in ("train", "test"))
        columns = feature_columns(train)
    model = train_model(train, columns, max_iterations=max_iterations)
    predictions = model.predict(test)
    return TrainingRun(
        model, tfidf, predictions, classification_report(predictions), confusion_matrix(predictions)
    )
