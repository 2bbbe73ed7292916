"""Sentiment analytics over community comments, as functions on Spark DataFrames."""

from .functions.text import clean_text, process_text
from .operators.labeling import add_sentiment_labels
from .operators.modeling import SentimentModel, train_model
from .operators.sampling import balance_classes, stratified_split
from .operators.scoring import lexicon_scorer, model_scorer, pandas_scorer, predict_texts
from .operators.tfidf import fit_tfidf, vocabulary
from .plans.engineer import engineer_features, train_and_evaluate
from .plans.preprocess import preprocess
from .plans.reports import author_report, community_report, thread_report, trend_report
from .session import configure, local_session

__all__ = [
    "SentimentModel",
    "add_sentiment_labels",
    "author_report",
    "balance_classes",
    "clean_text",
    "community_report",
    "configure",
    "engineer_features",
    "fit_tfidf",
    "lexicon_scorer",
    "local_session",
    "model_scorer",
    "pandas_scorer",
    "predict_texts",
    "preprocess",
    "process_text",
    "stratified_split",
    "thread_report",
    "train_and_evaluate",
    "train_model",
    "trend_report",
    "vocabulary",
]
