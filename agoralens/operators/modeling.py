"""Preparing data for a classifier, fitting it, and predicting with it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.labels import label_name
from .labeling import add_label_ids
from .scoring import add_record

# A column whose name starts so is a feature.
PREFIXES = ("tfidf_", "sentiment_", "score_")


def feature_columns(df: DataFrame, prefixes: tuple[str, ...] = PREFIXES) -> list[str]:
    """Numeric columns chosen by prefix, from the schema alone."""
    return [
        f.name for f in df.schema.fields if f.name.startswith(prefixes) and isinstance(f.dataType, NumericType)
    ]


def fill_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and NaNs become zero."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0)) for c in columns})


@dataclass(frozen=True)
class Standardizer:
    """Mean and population deviation per column, learnt from the training rows."""

    means: dict[str, float]
    deviations: dict[str, float]

    @classmethod
    def fit(cls, train: DataFrame, columns: list[str]) -> Standardizer:
        """One aggregation pass; the driver receives two numbers per column."""
        if not columns:
            return cls({}, {})
        moments = [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]
        moments += [F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]
        row = fill_missing(train.select(*columns), columns).agg(*moments).first()
        return cls(
            {c: row[f"m{i}"] or 0.0 for i, c in enumerate(columns)},
            {c: row[f"s{i}"] or 1.0 for i, c in enumerate(columns)},
        )

    def transform(self, df: DataFrame) -> DataFrame:
        filled = fill_missing(df, list(self.means))
        return filled.withColumns(
            {c: (F.col(c) - F.lit(m)) / F.lit(self.deviations[c]) for c, m in self.means.items()}
        )


@dataclass(frozen=True)
class SentimentModel:
    """A fitted classifier with the scaling it was trained on."""

    standardizer: Standardizer
    vectors: tuple[str, ...]
    classifier: LogisticRegressionModel

    def features(self, df: DataFrame) -> DataFrame:
        return _assemble(self.standardizer.transform(df), list(self.standardizer.means), self.vectors)

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``predicted_label``, ``confidence`` and ``probabilities``."""
        scored = self.classifier.transform(self.features(df))
        scored = scored.withColumn("_p", vector_to_array("probability"))
        kept = [c for c in df.columns if c not in ("sentiment", "confidence", "probabilities")]
        record = add_record(scored.withColumnRenamed("sentiment", "_true"), "_p")
        record = record.withColumnRenamed("sentiment", "predicted_label")
        if "sentiment" in df.columns:
            record = record.withColumnRenamed("_true", "sentiment")
            kept.append("sentiment")
        return record.select(*kept, "predicted_label", "confidence", "probabilities")

    def predict_labels(self, df: DataFrame) -> DataFrame:
        """Only the most probable class, as a name."""
        return self.classifier.transform(self.features(df)).withColumn(
            "predicted_label", label_name(F.col("prediction").cast("int"))
        )

    def save(self, path: str) -> None:
        """Write the classifier and, beside it, the scaling as a small table."""
        self.classifier.write().save(f"{path}/classifier")
        spark = _session()
        rows = [(c, m, self.standardizer.deviations[c]) for c, m in self.standardizer.means.items()]
        spark.createDataFrame(rows, "name string, mean double, deviation double").coalesce(1).write.parquet(
            f"{path}/scaling"
        )
        spark.createDataFrame([(v,) for v in self.vectors], "name string").coalesce(1).write.parquet(f"{path}/vectors")

    @classmethod
    def load(cls, path: str) -> SentimentModel:
        spark = _session()
        rows = spark.read.parquet(f"{path}/scaling").collect()
        vectors = tuple(r.name for r in spark.read.parquet(f"{path}/vectors").collect())
        scaling = Standardizer({r.name: r["mean"] for r in rows}, {r.name: r.deviation for r in rows})
        return cls(scaling, vectors, LogisticRegressionModel.load(f"{path}/classifier"))


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _assemble(df: DataFrame, columns: list[str], vectors: tuple[str, ...]) -> DataFrame:
    assembler = VectorAssembler(inputCols=[*columns, *vectors], outputCol="features", handleInvalid="error")
    return assembler.transform(df)


def train_model(
    train: DataFrame,
    columns: list[str] | None = None,
    vectors: tuple[str, ...] = ("tfidf",),
    label: str = "sentiment",
    max_iterations: int = 50,
    regularisation: float = 0.01,
    tolerance: float = 1e-6,
) -> SentimentModel:
    """A multinomial logistic regression over the scaled features and the sparse vectors.

    Each iteration is one pass of partial gradients over the executors.  The
    TF-IDF vectors stay sparse: the classifier scales them itself.
    """
    columns = feature_columns(train) if columns is None else columns
    vectors = tuple(v for v in vectors if v in train.columns)
    scaling = Standardizer.fit(train, columns)
    ready = _assemble(scaling.transform(add_label_ids(train, label, "label")), columns, vectors)
    learner = LogisticRegression(
        family="multinomial",
        featuresCol="features",
        labelCol="label",
        maxIter=max_iterations,
        regParam=regularisation,
        tol=tolerance,
        standardization=True,
    )
    return SentimentModel(scaling, vectors, learner.fit(ready.select("features", "label")))


def gradients(model: SentimentModel, train: DataFrame, label: str = "sentiment") -> DataFrame:
    """How far each coefficient is from the optimum of what ``train_model`` minimises over these rows.

    One row per class and term (-1 for the intercept) with the derivative of the mean
    log-loss plus the penalty, for features scaled by their deviations, as the penalty
    is.  All are 0 at the optimum.  The entries of sparse vectors are summed per term
    by a shuffle of partial sums; the coefficients are as many as features and classes.
    """
    spark = train.sparkSession
    classifier = model.classifier
    classes = range(classifier.numClasses)
    scored = classifier.transform(model.features(add_label_ids(train, label, "label")))
    vector = F.unwrap_udt("features")
    terms = F.when(vector["type"] == 0, vector["indices"]).otherwise(
        F.sequence(F.lit(0), F.greatest(F.size(vector["values"]) - 1, F.lit(0))))
    rest = [(vector_to_array("probability")[k] - (F.col("label") == k).cast("double")).alias(f"r{k}") for k in classes]
    rows = scored.select(F.arrays_zip(terms.alias("term"), vector["values"].alias("value")).alias("entries"), *rest)
    every = rows.withColumn("entries", F.concat(F.array(F.struct(F.lit(-1).alias("term"), F.lit(1.0).alias("value"))), "entries"))
    entries = every.select(F.explode("entries").alias("e"), *[f"r{k}" for k in classes]).select("e.*", *[f"r{k}" for k in classes])
    sums = entries.groupBy("term").agg(
        F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"),
        *[F.sum(F.col("value") * F.col(f"r{k}")).alias(f"g{k}") for k in classes],
    )
    n = rows.agg(F.count(F.lit(1)).cast("double")).scalar()
    matrix, own = classifier.coefficientMatrix.toArray(), classifier.interceptVector.toArray()
    known = [(-1, *map(float, own))] + [(j, *map(float, matrix[:, j])) for j in range(matrix.shape[1])]
    weights = spark.createDataFrame(known, "term int, " + ", ".join(f"w{k} double" for k in classes))
    deviation = F.sqrt((F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1))
    joined = sums.join(weights, "term").withColumn("n", n).withColumn("d", F.when(F.col("term") == -1, 1.0).otherwise(deviation))
    penalty = F.when(F.col("term") == -1, 0.0).otherwise(F.lit(float(classifier.getRegParam())))
    one = F.array(*[
        F.struct(F.lit(k).alias("class"), (F.col(f"g{k}") / F.col("n") / F.col("d") + penalty * F.col(f"w{k}") * F.col("d")).alias("gradient"))
        for k in classes
    ])
    return joined.filter("d > 0").select("term", F.inline(one))
