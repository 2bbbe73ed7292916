"""Reading comment tables and writing dataset snapshots."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .csv import read_csv
from .files import mark, names
from .schema import COMMENTS, RAW_THREAD

SITE = "https://reddit.com"
_RUN = re.compile(r"\d{8}_\d{6}(_\w+)?")


def read_comments(spark: SparkSession, path: str, schema: T.StructType = COMMENTS) -> DataFrame:
    """Comments at rest as parquet."""
    return spark.read.schema(schema).parquet(path)


def read_comments_csv(spark: SparkSession, path: str, schema: T.StructType = COMMENTS) -> DataFrame:
    """Comments at rest as CSV with a header; texts may hold line breaks and quotes.

    The columns are those of the header, typed by the schema.  Files are read in splits.
    """
    return read_csv(spark, path, schema)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return path


def write_snapshot(df: DataFrame, root: str, name: str, run: str | None = None) -> str | None:
    """Write a dataset as a new snapshot; an empty one is refused and gives no path.

    ``run`` (``YYYYmmdd_HHMMSS``) defaults to the current UTC time.  An existing
    snapshot is never overwritten.
    """
    if df.isEmpty():
        return None
    run = run or datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
    if not _RUN.fullmatch(run):
        raise ValueError(f"a run is named YYYYmmdd_HHMMSS, not {run!r}")
    path = f"{root}/{name}/run_ts={run}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_newest(spark: SparkSession, root: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """The newest complete snapshot, found by the names of the folders; no other one is opened.

    Without a schema that of its files is taken.
    """
    folder = f"{root}/{name}"
    for run in reversed([n for n in names(spark, folder) if n.startswith("run_ts=")]):
        if "_SUCCESS" in names(spark, f"{folder}/{run}"):
            return (spark.read.schema(schema) if schema else spark.read).parquet(f"{folder}/{run}")
    raise FileNotFoundError(f"no snapshot of {name} in {root}")


def append_batch(df: DataFrame, path: str) -> None:
    """Add one batch of collected comments to the accumulated table."""
    df.write.mode("append").parquet(path)


def commit_batch(df: DataFrame, root: str, batch: str) -> bool:
    """Add one batch to an accumulated table exactly once; whether it was new.

    The rows are written to a folder of the batch, and then its id to the log beside
    them, in one step of the store.  A batch that the log has is not written again; what
    a job left that died before that is overwritten, and readers, who follow the log,
    have not seen it.
    """
    if not re.fullmatch(r"[\w-]+", batch):
        raise ValueError(f"a batch is named by letters, digits, - and _, not {batch!r}")
    spark = df.sparkSession
    if batch in committed_batches(spark, root):
        return False
    df.write.mode("overwrite").parquet(f"{root}/batch={batch}")
    return mark(spark, f"{root}/_log/{batch}")


def committed_batches(spark: SparkSession, root: str) -> list[str]:
    return names(spark, f"{root}/_log")


def read_batches(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """All committed batches; columns that a batch lacks are null."""
    found = [f"{root}/batch={b}" for b in committed_batches(spark, root)]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def accumulate(batches: list[DataFrame]) -> DataFrame:
    """All batches as one table; columns a batch lacks are null."""
    result = batches[0]
    for batch in batches[1:]:
        result = result.unionByName(batch, allowMissingColumns=True)
    return result


def _judged_threads(raw: DataFrame, column: str) -> DataFrame:
    """Posts as (raw, post, reason); the reason is null for those that give comments."""
    known = T.StructType([*RAW_THREAD.fields, T.StructField("_broken", T.StringType())])
    posts = raw.select(
        F.col(column).alias("raw"), F.from_json(column, known, {"columnNameOfCorruptRecord": "_broken"}).alias("post")
    )
    comments = F.col("post.comments")
    reason = (
        F.when(F.col("raw").isNull() | F.col("post").isNull() | F.col("post._broken").isNotNull(), "bad_json")
        .when(F.col("post.id").isNull(), "no_post_id")
        .when(comments.isNull() | (F.size(comments) == 0), "no_comments")
        .when(F.exists(comments, lambda c: c.isNull() | c["id"].isNull()), "no_comment_id")
    )
    return posts.withColumn("reason", reason)


def rejected_threads(raw: DataFrame, column: str = "value") -> DataFrame:
    """The posts that ``flatten_threads`` has no rows of, as (raw, reason); on a stream, too.

    A post is kept whole or rejected whole: ``bad_json`` (or a value of a wrong type),
    ``no_post_id``, ``no_comments`` or ``no_comment_id``.
    """
    return _judged_threads(raw, column).filter("reason is not null").select("raw", "reason")


def flatten_threads(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON posts with their comments to one row per comment.

    Seconds since the epoch become UTC timestamps, permalinks get the site's
    address, a missing controversiality is 0.  Posts that can't be read whole are left
    to ``rejected_threads``.
    """
    thread = _judged_threads(raw, column).filter("reason is null")
    rows = thread.select("post", F.explode("post.comments").alias("c"))
    return rows.select(
        F.col("c.id").alias("comment_id"),
        F.col("c.body").alias("text"),
        F.col("post.subreddit").alias("subreddit"),
        F.col("c.score").alias("score"),
        F.timestamp_micros((F.col("c.created_utc") * 1000000).cast("bigint")).alias("created_utc"),
        F.col("post.title").alias("post_title"),
        F.col("post.id").alias("post_id"),
        F.col("post.over_18").alias("over_18"),
        F.col("c.is_submitter").alias("is_submitter"),
        F.concat(F.lit(SITE), F.col("c.permalink")).alias("permalink"),
        F.coalesce("c.controversiality", F.lit(0)).alias("controversiality"),
        F.col("post.listing").alias("listing"),
    )
