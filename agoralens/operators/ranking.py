"""First rows per key, exact and without one large task per key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def _salts(df: DataFrame) -> int:
    """Salts for two rounds: the square root of the partitions, so that both rounds gather about as much per task.

    The shuffle partitions stand for them: they are set to the size of the input.
    """
    return max(2, round(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))


def first_n_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank: str = "rank",
    salts: int | None = None,
) -> DataFrame:
    """Exactly the first ``n`` rows of each key in the given order, with their rank.

    Two rounds.  The first ranks within (key, salt), where all rows of an input
    partition share a salt: Spark drops all but ``n`` rows per key inside each
    partition before the shuffle, and a key holding most of the table is spread
    over ``salts`` tasks (by default the square root of the session's shuffle
    partitions).  The second round sees at most ``n * salts`` rows per
    key.  The order must end in a unique column.  For a very small ``n`` the rows
    left by the partitions are few enough for one round: ``salts=1``.
    """
    salts = _salts(df) if salts is None else salts
    if salts <= 1:
        return _ranked(df, keys, order, n, rank)
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    return _ranked(
        _ranked(salted, [*keys, "_salt"], order, n, "_rank").drop("_salt", "_rank"), keys, order, n, rank
    )


def _ranked(df, keys, order, n, rank):
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def first_n(df: DataFrame, order: Sequence[Column], n: int, salts: int | None = None) -> DataFrame:
    """The first ``n`` rows of the whole table.

    The salted round keeps the last task from receiving ``n`` rows of every partition.
    """
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts or _salts(df))))
    return _ranked(salted, ["_salt"], order, n, "_rank").drop("_salt", "_rank").orderBy(*order).limit(n)


def first_n_by_cutoff(df: DataFrame, keys: Sequence[str], order: Column, n: int) -> DataFrame:
    """The first ``n`` rows of each key, for wide rows and many keys.

    ``order`` is one column, usually a struct, that sorts the wanted rows first and
    is unique within a key.  Only keys and order are ranked, so the wide columns are
    neither read nor shuffled for it.  The outcome is the ``n``-th order value of each
    key that has that many rows; other keys need none.  The wide rows are then
    filtered by it: the table of cut-offs is at rest, so the planner broadcasts it if
    its size allows and otherwise joins by key, splitting a hot one.
    """
    narrow = df.select(*keys, order.alias("_order"))
    nth = first_n_per_key(narrow, keys, [F.asc("_order")], n, "_rank").filter(F.col("_rank") == n)
    cutoffs = materialize(nth.select(*keys, F.col("_order").alias("_cutoff")), "cutoffs")
    kept = join_null_safe(df.withColumn("_order", order), cutoffs, keys, "left")
    return kept.filter(F.col("_cutoff").isNull() | (F.col("_order") <= F.col("_cutoff"))).select(*df.columns)


def join_null_safe(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key matches a null key, as it does in a grouping."""
    renamed = other.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return df.join(renamed, same, how).drop(*[f"_k_{k}" for k in keys])


def newest_first(at: str, then: str) -> Column:
    """An order for ``first_n_by_cutoff``: latest time first, then the id; no time comes last."""
    return F.struct(F.coalesce(-F.unix_micros(at), F.lit(2**63 - 1)).alias("a"), F.col(then).alias("b"))


def hash_key(id_column: Column, seed: int) -> Column:
    """A repeatable pseudo-random order: md5 of the id and the seed."""
    return F.md5(F.concat(id_column.cast("string"), F.lit("|"), F.lit(str(seed))))


def hash_bucket(key: Column, digits: int) -> Column:
    """The leading hex digits; buckets sort the same way as the keys in them."""
    return F.substring(key, 1, digits)


def bucket_offsets(df: DataFrame, group: str, bucket: str) -> DataFrame:
    """Rows per (group, bucket) and the rows of the group in earlier buckets.

    One pre-aggregated row per group and bucket; the running sum is over those.
    """
    counts = df.groupBy(group, bucket).agg(F.count(F.lit(1)).alias("_in_bucket"))
    window = Window.partitionBy(group).orderBy(bucket)
    return counts.withColumn("_before", F.sum("_in_bucket").over(window) - F.col("_in_bucket"))


def hash_cutoffs(df: DataFrame, group: str, key: str, wanted: Column, digits: int = 4) -> DataFrame:
    """Per group the key of the row ranked ``wanted`` by key.

    Counts per hash bucket find the bucket that holds the row; only that bucket's
    rows are ranked.  With d hex digits a group's rows spread over 16**d buckets.
    ``wanted`` may use ``_total``, the rows of the group.  Groups that want no
    row are absent.  Returns one row per group: group, ``cutoff``.  Groups are
    classes: the boundary table has one row for each and is broadcast.
    """
    keyed = df.select(group, key, hash_bucket(F.col(key), digits).alias("_bucket"))
    offsets = bucket_offsets(keyed, group, "_bucket")
    totals = Window.partitionBy(group)
    boundary = (
        offsets.withColumn("_total", F.sum("_in_bucket").over(totals))
        .withColumn("_wanted", wanted)
        .filter((F.col("_before") < F.col("_wanted")) & (F.col("_wanted") <= F.col("_before") + F.col("_in_bucket")))
        .select(group, "_bucket", (F.col("_wanted") - F.col("_before")).alias("_nth"))
    )
    inside = keyed.join(F.broadcast(boundary), [group, "_bucket"])
    window = Window.partitionBy(group).orderBy(key)
    return (
        inside.withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") == F.col("_nth"))
        .select(group, F.col(key).alias("cutoff"))
    )


def hash_rank(df: DataFrame, group: str, key: str, rank: str = "rank", digits: int = 4) -> DataFrame:
    """Rank of every row within its group by key, starting at 1.

    The rank is the rows in earlier buckets plus the rank inside the bucket, so
    no task holds more than one bucket of one group.
    """
    keyed = df.withColumn("_bucket", hash_bucket(F.col(key), digits))
    offsets = bucket_offsets(keyed.select(group, "_bucket"), group, "_bucket")
    window = Window.partitionBy(group, "_bucket").orderBy(key)
    return (
        keyed.withColumn("_inner", F.row_number().over(window))
        .join(offsets.drop("_in_bucket"), [group, "_bucket"])
        .withColumn(rank, (F.col("_before") + F.col("_inner")).cast("bigint"))
        .drop("_bucket", "_inner", "_before")
    )
