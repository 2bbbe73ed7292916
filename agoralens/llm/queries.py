"""The named queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..session import configure
from . import byte_bpe
from .bpe import encode
from .collocations import collocations
from .decontamination import decontaminate
from .hash_ring import shard_rows
from .hyperminhash import near_duplicates
from .packing import RankIds, pack
from .periodic_runs import find_runs
from .quality_rules import apply_quality_rules
from .substring_dedup import remove_repeated_windows
from .suffix_dedup import remove_repeated_strings
from .token_counts import count_tokens, sentencepiece_pieces
from .warc import derivatives, page_responses

# The tokenizer of op6; its file comes with the public tokenizers.
WORD_BPE = "word_bpe_49k.json"
# The pieces that op5 counts, and the ranks that op9 and op13 encode with.
PIECES = "piece_bpe_32k.model"
RANKS = "byte_bpe_50k.tiktoken"
SHARDS = 24

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def settings(spark: SparkSession) -> SparkSession:
    """The settings that the operators rely on; Arrow batches of long texts are bounded by bytes, not by rows alone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return configure(spark)


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(settings(spark), sf_dir)

    QUERIES[function.__name__] = run
    return function


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


@query
def op1_substring_dedup(spark, sf_dir):
    return remove_repeated_windows(_documents(spark, sf_dir)).select(
        "row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


@query
def op2_suffix_dedup(spark, sf_dir):
    return remove_repeated_strings(_documents(spark, sf_dir)).select(
        "row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op3_warc_derivatives(spark, sf_dir):
    records = derivatives(page_responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return records.select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri", "content_type", "content_length",
        "block_digest", "payload_digest", F.sha2("record", 256).alias("record_sha256"),
    )


@query
def op4_hyperminhash(spark, sf_dir):
    return near_duplicates(_documents(spark, sf_dir))


@query
def op5_token_counts(spark, sf_dir):
    pieces = sentencepiece_pieces(tokenizer_path(PIECES))
    return count_tokens(_documents(spark, sf_dir), pieces).drop("text")


@query
def op6_bpe(spark, sf_dir):
    return encode(_documents(spark, sf_dir), tokenizer_path(WORD_BPE)).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op7_decontamination(spark, sf_dir):
    found = decontaminate(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query
def op8_hash_ring(spark, sf_dir):
    return shard_rows(_documents(spark, sf_dir), SHARDS).withColumns({
        "law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")
    })


@query
def op9_packing(spark, sf_dir):
    import public_tokenizers

    tokens = RankIds(spark, tokenizer_path(RANKS), public_tokenizers.PATTERN)
    return pack(_documents(spark, sf_dir), tokens, "text", tokens.vocabulary)


@query
def op10_quality_rules(spark, sf_dir):
    return apply_quality_rules(_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op13_byte_bpe(spark, sf_dir):
    import public_tokenizers

    path = tokenizer_path(RANKS)
    coded = byte_bpe.encode(_documents(spark, sf_dir), path, public_tokenizers.PATTERN, keep=["doc_id"])
    return byte_bpe.decode(coded, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("packed_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op11_collocations(spark, sf_dir):
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """A tenth of the documents, chosen by the checksum of the id, with their words repeated from some place on."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(0))
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        seed = F.floor(checksum / 10)
        first = F.pmod(seed, n)
        period = 1 + F.floor((n - first) / (3 + F.pmod(seed, F.lit(8))))
        place = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(
            i < first, i).otherwise(first + F.pmod(i - first, period)))
        return F.when(F.size(w) > 0, F.array_join(F.transform(place, lambda i: F.get(w, i.cast("int"))), " "))

    return documents.withColumn("text", F.when(checksum % 10 == 0, let(words, repeated)).otherwise(F.col("text")))


@query
def op12_periodic_runs(spark, sf_dir):
    found = find_runs(with_planted_runs(_documents(spark, sf_dir)))

    def better(a: Column, b: Column) -> Column:
        """The run of the greater exponent, compared exactly; the runs come by start, then period."""
        return F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)

    best = F.reduce("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), better)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", "runs", "collapsed", best.alias("best"), F.array_join(lines, "").alias("lines")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
