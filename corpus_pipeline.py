"""The stages that turn ``documents`` into token ids for training.

Each stage takes (spark, docs, folder of the tables) and returns a table; all but the
last return the columns of ``docs``.  Rows without an id pass every stage that they are
not rejected by; an empty table passes as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agoralens.llm.bpe import encode
from agoralens.llm.decontamination import decontaminate
from agoralens.llm.hyperminhash import near_duplicates
from agoralens.llm.quality_rules import apply_quality_rules
from agoralens.llm.queries import WORD_BPE, settings, tokenizer_path
from agoralens.llm.suffix_dedup import remove_repeated_strings
from agoralens.session import materialize

ORACLE_SQL = None  # near duplicates and BPE are no SQL


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    settings(spark)
    judged = apply_quality_rules(docs.select(F.struct("*").alias("doc"), "text"))
    return judged.filter("kept").select("doc.*")


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-duplicate texts, the one with the smallest id."""
    settings(spark)
    gone = near_duplicates(docs.select("doc_id", "text")).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def without_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that occur before; ``n_chars`` follows the text."""
    settings(spark)
    left = remove_repeated_strings(docs).select("row.*", F.col("kept_text").alias("text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        left = left.withColumn("n_chars", F.char_length("text").cast(kind))
    return left.select(*docs.columns)


def without_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    settings(spark)
    found = decontaminate(docs.select(F.struct("*").alias("doc"), "doc_id", "text"),
                          spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter("not contaminated").select("doc.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids and what these decode to."""
    settings(spark)
    return encode(docs, tokenizer_path(WORD_BPE)).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", one_of_near_duplicates),
    ("suffix-array dedup", without_repeated_strings),
    ("benchmark decontamination", without_benchmark_passages),
    ("BPE encoding", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written down before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
