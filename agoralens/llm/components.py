"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(links: DataFrame) -> DataFrame:
    """(key, component) for each key of the links ``a``, ``b``; the component is its smallest key.

    Large-star and small-star steps in turn: each key hands its smallest neighbour to
    the others, until every link points at the smallest key of its component.  The
    links stay in tables; each round is written down, and the driver sees two numbers.
    The number of rounds grows with the logarithm of the longest chain.  Joins are by
    key, and hot keys are left to the planner, which splits them.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links = materialize(links.distinct(), "links")
    state = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(own, "u")
            .filter("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(own.select("u", F.col("m").alias("v")))
        )
        links = materialize(small.distinct(), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = links.select(F.col("v").alias("key"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("key"), F.col("v").alias("component")).unionByName(roots)
