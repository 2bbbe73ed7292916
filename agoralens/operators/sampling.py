"""Class balancing and the stratified split, repeatable by hashing row ids."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.wordlists import LABELS
from ..session import materialize
from .ranking import hash_cutoffs, hash_key, hash_rank

SEED = 42


def class_counts(df: DataFrame, label: str = "sentiment") -> dict[str, int]:
    """Rows of each of the three classes; the driver receives three numbers."""
    rows = df.filter(F.col(label).isin(LABELS)).groupBy(label).count().collect()
    found = {r[label]: r["count"] for r in rows}
    return {name: found.get(name, 0) for name in LABELS}


def balance_classes(
    df: DataFrame,
    strategy: str = "hybrid",
    label: str = "sentiment",
    key: str = "comment_id",
    seed: int = SEED,
    copy_column: str | None = None,
) -> DataFrame:
    """Bring each class to the mean class size.

    Larger classes are sampled without replacement, the others with replacement;
    rows of no class are dropped.  Another strategy, or a table without the label
    column, is returned unchanged.  ``key`` is unique.

    Ranks and cut-offs are found on a narrow table of classes and hashed keys,
    written once.  A larger class keeps the rows up to its cut-off in hash order,
    marked without a shuffle.  For the others every copy draws a rank by hash, and the
    rows of the drawn keys are fetched by one join; a row drawn very often is one side
    of a skewed join, which Spark splits.
    """
    if strategy != "hybrid" or label not in df.columns:
        return df
    keyed = df.withColumn("_key", hash_key(F.col(key), seed))
    keys = _class_keys(keyed, label)
    counts = class_counts(keys, label)
    target = sum(counts.values()) // len(counts)
    if target > 0 and min(counts.values()) == 0:
        empty = [name for name, n in counts.items() if n == 0]
        raise ValueError(f"cannot draw {target} rows from the empty classes {empty}")
    columns = [F.col(c) for c in df.columns]
    original, copied = columns, columns
    if copy_column:
        original = [*columns, F.lit(0).cast("bigint").alias(copy_column)]
        copied = [*columns, F.col("_copy").alias(copy_column)]
    large = [name for name, n in counts.items() if n > target]
    small = [name for name, n in counts.items() if n <= target]

    parts = []
    if large:
        # At most two keys.  As constants they are compared before costly columns of ``df`` are computed.
        cutoffs = hash_cutoffs(keys.filter(F.col(label).isin(large)), label, "_key", F.lit(target)).collect()
        first = [(F.col(label) == c[label]) & (F.col("_key") <= c["cutoff"]) for c in cutoffs]
        if first:
            parts.append(keyed.filter(reduce(or_, first)).select(original))
    if small and target:
        ranked = hash_rank(keys.filter(F.col(label).isin(small)), label, "_key", "_rank")
        draws = reduce(
            DataFrame.unionByName, [_draws(df, label, name, target, counts[name], seed) for name in small]
        )
        drawn = draws.join(ranked, [label, "_rank"]).select("_key", "_copy")
        rows = keyed.filter(F.col(label).isin(small))
        parts.append(rows.join(drawn, "_key").select(copied))
    return reduce(DataFrame.unionByName, parts) if parts else df.select(original).filter(F.lit(False))


def _class_keys(keyed: DataFrame, label: str) -> DataFrame:
    """Class and hashed key of every row of a class, at rest: it is read several times."""
    return materialize(keyed.filter(F.col(label).isin(LABELS)).select(label, "_key"), "class-keys")


def _draws(df: DataFrame, label: str, name: str, copies: int, rows: int, seed: int) -> DataFrame:
    """One row per copy with the drawn rank from 1 to ``rows``."""
    ticket = F.md5(F.concat_ws("|", F.lit(name), F.col("id").cast("string"), F.lit(str(seed))))
    number = F.conv(F.substring(ticket, 1, 15), 16, 10).cast("bigint")
    return df.sparkSession.range(1, copies + 1).select(
        F.col("id").alias("_copy"),
        F.lit(name).alias(label),
        (F.pmod(number, F.lit(rows).cast("bigint")) + 1).alias("_rank"),
    )


def stratified_split(
    df: DataFrame,
    test_fraction: float = 0.2,
    label: str = "sentiment",
    key: str = "comment_id",
    seed: int = SEED,
) -> DataFrame:
    """Add ``split`` (train or test); each class gives its rounded share to test.

    The rows that come first in hash order are the test rows.  Once the cut-offs
    (one per class) are known, marking the rows is a pass without shuffle.  ``key``
    is unique.
    """
    classes = df.filter(F.col(label).isin(LABELS)).withColumn("_key", hash_key(F.col(key), seed))
    cutoffs = hash_cutoffs(_class_keys(classes, label), label, "_key", F.round(F.col("_total") * F.lit(test_fraction)).cast("bigint"))
    is_test = F.coalesce(F.col("_key") <= F.col("cutoff"), F.lit(False))
    return (
        classes.join(F.broadcast(cutoffs), label, "left")
        .withColumn("split", F.when(is_test, "test").otherwise("train"))
        .select(*[F.col(c) for c in df.columns], "split")
    )
