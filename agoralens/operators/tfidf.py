"""TF-IDF over words and bigrams."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bigrams, string_array, term_words, terms
from ..functions.wordlists import TFIDF_STOP_WORDS

MAX_FEATURES = 1000
# Words that are fetched per wanted term, so that those of equal frequency are all known.
TIES = 4
# Stands for "one document" in the term counts; no term is empty.
_DOCUMENT = ""


def term_counts(df: DataFrame, text: str = "processed_text", stop_words: list[str] = TFIDF_STOP_WORDS) -> DataFrame:
    """Occurrences and documents of every term, and of the empty term: the documents.

    A row is a document, so the distinct terms of a document are known inside the
    row.  The only shuffle carries one partial count per term and partition; pairs
    of document and term are never shuffled.
    """
    return _counts(df, terms(F.col(text), stop_words))


def _counts(df: DataFrame, found: Column) -> DataFrame:
    """Occurrences and documents of what an array column lists, and of the empty term.

    Sorted, equal terms of a document are neighbours, and the first of them counts the
    document: one row per occurrence goes into the partial counts.
    """
    listed = df.select(F.sort_array(F.coalesce(found, F.array().cast("array<string>"))).alias("t"))

    def mark(t: Column, i: Column) -> Column:
        again = F.coalesce(F.get("t", i - 1) == t, F.lit(False))
        return F.struct(t.alias("term"), F.lit(1).alias("tf"), F.when(again, 0).otherwise(1).alias("df"))

    document = F.array(F.struct(F.lit(_DOCUMENT).alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df")))
    return (
        listed.select(F.inline(F.concat(F.transform("t", mark), document)))
        .groupBy("term")
        .agg(F.sum("tf").alias("term_frequency"), F.sum("df").alias("document_frequency"))
    )


def vocabulary(
    df: DataFrame,
    text: str = "processed_text",
    max_features: int = MAX_FEATURES,
    stop_words: list[str] = TFIDF_STOP_WORDS,
) -> DataFrame:
    """The most frequent terms of the corpus; equal frequencies go by the term."""
    counts = term_counts(df, text, stop_words).filter(F.col("term") != _DOCUMENT)
    return counts.orderBy(F.desc("term_frequency"), F.asc("term")).limit(max_features)


@dataclass(frozen=True)
class TfidfModel:
    """Terms in alphabetical order with their weights; at most ``max_features`` of them."""

    terms: list[str]
    idf: list[float]
    stop_words: list[str]

    def transform(self, df: DataFrame, text: str = "processed_text", output: str = "tfidf") -> DataFrame:
        """Add the sparse, L2-normalised vector of each document; a pass without shuffle."""
        if not self.terms:
            raise ValueError("the vocabulary is empty")
        counter = CountVectorizerModel.from_vocabulary(self.terms, inputCol="_terms", outputCol="_tf", minTF=1.0)
        weigh = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="_tf", outputCol="_weighted")
        scale = Normalizer(p=2.0, inputCol="_weighted", outputCol=output)
        empty = F.array().cast("array<string>")
        counted = counter.transform(
            df.withColumn("_terms", F.coalesce(terms(F.col(text), self.stop_words), empty))
        )
        return scale.transform(weigh.transform(counted)).drop("_terms", "_tf", "_weighted")

    def save(self, path: str) -> None:
        """Write terms, weights and stop words as two small tables."""
        spark = SparkSession.active()
        rows = list(zip(range(len(self.terms)), self.terms, self.idf, strict=True))
        spark.createDataFrame(rows, "i int, term string, idf double").coalesce(1).write.parquet(f"{path}/terms")
        words = spark.createDataFrame([(w,) for w in self.stop_words], "word string")
        words.coalesce(1).write.parquet(f"{path}/stop_words")

    @classmethod
    def load(cls, path: str) -> TfidfModel:
        spark = SparkSession.active()
        rows = spark.read.parquet(f"{path}/terms").orderBy("i").collect()
        words = [r.word for r in spark.read.parquet(f"{path}/stop_words").collect()]
        return cls([r.term for r in rows], [r.idf for r in rows], words)


def fit_tfidf(
    df: DataFrame,
    text: str = "processed_text",
    max_features: int = MAX_FEATURES,
    stop_words: list[str] = TFIDF_STOP_WORDS,
) -> TfidfModel:
    """Vocabulary and weights ``ln((1 + n) / (1 + df)) + 1``.

    Words are counted first.  A bigram occurs no more often than either of its words, so
    one with a word below the last wanted rank can't be among the terms: only bigrams of
    two frequent words are counted, and the many rare ones never reach the shuffle.  The
    terms are those that ``vocabulary`` finds.  The driver receives the row of the empty
    term, which is kept by sorting it first, and a few times ``max_features`` words.
    """
    words = term_words(F.col(text), stop_words)
    most = TIES * max_features
    found = _most_frequent(_counts(df, words), most + 1)
    documents = next((r.document_frequency for r in found if r.term == _DOCUMENT), 0)
    singles = [r for r in found if r.term != _DOCUMENT]
    pairs = _counts(df, bigrams(words, _frequent(singles, max_features, most)))
    rows = singles + [r for r in _most_frequent(pairs, max_features + 1) if r.term != _DOCUMENT]
    rows = sorted(rows, key=lambda r: (-r.term_frequency, r.term))[:max_features]
    chosen = sorted((r.term, r.document_frequency) for r in rows)
    return TfidfModel(
        [term for term, _ in chosen],
        [math.log((1 + documents) / (1 + found)) + 1 for _, found in chosen],
        list(stop_words),
    )


def _most_frequent(counts: DataFrame, n: int) -> list[Row]:
    is_document = F.col("term") == _DOCUMENT
    return counts.orderBy(F.desc(is_document), F.desc("term_frequency"), F.asc("term")).limit(n).collect()


def _frequent(singles: list[Row], wanted: int, most: int) -> list[str] | None:
    """The words at least as frequent as the last wanted one; None if they are not all known."""
    if not 0 < wanted <= len(singles):
        return None
    least = singles[wanted - 1].term_frequency
    if len(singles) >= most and singles[-1].term_frequency >= least:
        return None
    return [r.term for r in singles if r.term_frequency >= least]


def long_weights(df: DataFrame, model: TfidfModel, key: str, vector: str = "tfidf") -> DataFrame:
    """One row per document and term of weight above zero: key, ``term_index``, ``term``, ``weight``."""
    names = string_array(model.terms)
    v = F.unwrap_udt(vector)
    # A sparse vector lists the places of its values.
    places = F.when(v["type"] == 0, v["indices"]).otherwise(F.sequence(F.lit(0), F.greatest(F.size(v["values"]) - 1, F.lit(0))))
    pairs = F.arrays_zip(places.alias("term_index"), v["values"].alias("weight"))
    return (
        df.select(key, F.inline(pairs).alias("term_index", "weight"))
        .filter("weight > 0")
        .select(key, "term_index", names[F.col("term_index")].alias("term"), "weight")
    )


def wide_weights(df: DataFrame, model: TfidfModel, vector: str = "tfidf") -> DataFrame:
    """Dense columns ``tfidf_0 ..`` in alphabetical order of the terms, instead of the vector."""
    dense = df.withColumn("_dense", vector_to_array(vector))
    columns = [F.col("_dense")[i].alias(f"tfidf_{i}") for i in range(len(model.terms))]
    return dense.select(*[c for c in df.columns if c != vector], *columns)
