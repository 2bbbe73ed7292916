"""Evaluation of predictions against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.wordlists import LABELS
from .ranking import first_n_per_key

TRUE, PREDICTED = "sentiment", "predicted_label"


def _pair_counts(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """The nine counts as one row; one pass with partial aggregates."""
    return df.agg(
        *[
            F.count_if((F.col(true) == t) & (F.col(predicted) == p)).alias(f"{t}_{p}")
            for t in LABELS
            for p in LABELS
        ]
    )


def confusion_matrix(df: DataFrame, true: str = TRUE, predicted: str = PREDICTED) -> DataFrame:
    """Rows are true labels, columns predicted ones; zeros are kept."""
    rows = [
        F.struct(
            F.lit(i).alias("label"),
            F.lit(t).alias("true_label"),
            *[F.col(f"{t}_{p}").alias(f"predicted_{p}") for p in LABELS],
        )
        for i, t in enumerate(LABELS)
    ]
    return _pair_counts(df, true, predicted).select(F.inline(F.array(*rows)))


def _ratio(top: Column, bottom: Column) -> Column:
    """Zero where it is undefined."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def classification_report(df: DataFrame, true: str = TRUE, predicted: str = PREDICTED) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and the two averages.

    For the accuracy row the value stands in ``f1_score``.
    """
    counts = _pair_counts(df, true, predicted)
    per_class = []
    for name in LABELS:
        hit = F.col(f"{name}_{name}")
        guessed = sum((F.col(f"{t}_{name}") for t in LABELS), F.lit(0))
        support = sum((F.col(f"{name}_{p}") for p in LABELS), F.lit(0))
        precision, recall = _ratio(hit, guessed), _ratio(hit, support)
        per_class.append(
            F.struct(
                F.lit(name).alias("row"),
                precision.alias("precision"),
                recall.alias("recall"),
                _ratio(2.0 * precision * recall, precision + recall).alias("f1_score"),
                support.cast("bigint").alias("support"),
            )
        )
    table = counts.withColumn("classes", F.array(*per_class)).withColumn(
        "total", F.aggregate("classes", F.lit(0).cast("bigint"), lambda a, c: a + c["support"])
    )
    hits = sum((F.col(f"{name}_{name}") for name in LABELS), F.lit(0))

    def average(field: str, weighted: bool) -> Column:
        weight = (lambda c: c["support"].cast("double")) if weighted else (lambda c: F.lit(1.0))
        top = F.aggregate("classes", F.lit(0.0), lambda a, c: a + c[field] * weight(c))
        return _ratio(top, F.col("total") if weighted else F.lit(len(LABELS)))

    def summary(name: str, weighted: bool) -> Column:
        return F.struct(
            F.lit(name).alias("row"),
            *[average(f, weighted).alias(f) for f in ("precision", "recall", "f1_score")],
            F.col("total").alias("support"),
        )

    accuracy = F.struct(
        F.lit("accuracy").alias("row"),
        F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"),
        _ratio(hits, F.col("total")).alias("f1_score"),
        F.col("total").alias("support"),
    )
    rows = F.concat(
        F.col("classes"), F.array(accuracy, summary("macro avg", False), summary("weighted avg", True))
    )
    return table.select(F.inline(rows))


def error_examples(
    df: DataFrame, key: str, true: str = TRUE, predicted: str = PREDICTED, text: str = "text", examples: int = 3
) -> DataFrame:
    """Per pair of true and wrongly predicted label: the count and the first texts by key.

    There are at most six pairs.  Counts are pre-aggregated.  Only pairs and keys are
    ranked; the few chosen keys are broadcast, and only their texts leave the scan.
    """
    wrong = df.filter((F.col(true) != F.col(predicted)) & F.col(true).isin(LABELS) & F.col(predicted).isin(LABELS))
    wrong = wrong.select(
        F.col(true).alias("true_label"), F.col(predicted).alias("predicted_label"), F.col(key).alias("_key"), text
    )
    pair = ["true_label", "predicted_label"]
    counts = wrong.groupBy(*pair).agg(F.count(F.lit(1)).alias("count"))
    first = first_n_per_key(wrong.select(*pair, "_key"), pair, [F.asc("_key")], examples)
    # At most six pairs times ``examples`` keys.
    chosen = wrong.join(F.broadcast(first.drop("rank").distinct()), [*pair, "_key"])
    ordered = F.array_sort(F.collect_list(F.struct("_key", text)))
    texts = chosen.groupBy(*pair).agg(
        F.transform(F.slice(ordered, 1, examples), lambda r: r[text]).alias("examples")
    )
    return counts.join(F.broadcast(texts), pair)
