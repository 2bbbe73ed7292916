"""Exact percentiles of large groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .ranking import join_null_safe

BUCKETS = 4096
# Values of a range that are put in order as they are.
ORDERED = 100_000


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    points: Sequence[float],
    buckets: int = BUCKETS,
    ordered: int = ORDERED,
) -> DataFrame:
    """Percentiles with linear interpolation, one column ``p_<point>`` per point.

    A large group must not be one task's work, as it would be for the built-in exact
    ``percentile``, and also for a sketch, whose large states are merged by one task.
    So the wanted ranks are searched for: the range that holds a rank is cut into
    buckets, rows per bucket are counted with partial aggregates, and the bucket that
    holds the rank becomes the next range.  A range of up to ``ordered`` rows is put in
    order, counted per distinct value.  The least and the greatest value of a range fall
    into different buckets, so each round narrows every range that it cuts.

    The input is read once per round, so it should be at rest.  Nulls and NaNs are
    left out; infinities are ranges of their own.
    """
    group = list(keys) or ["_all"]
    values = df if keys else df.withColumn("_all", F.lit(0))
    values = values.select(*group, F.col(value).cast("double").alias("_v")).filter("_v is not null and not isnan(_v)")
    finite = F.when(F.abs("_v") < INFINITY, F.col("_v"))
    sizes = materialize(
        values.groupBy(*group).agg(
            F.count(F.lit(1)).alias("_n"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi"),
            F.count_if(F.col("_v") == -INFINITY).alias("_least"), F.count_if(F.col("_v") == INFINITY).alias("_most"),
        ),
        "sizes",
    )
    ranks = F.array_distinct(F.array(*[f(_position(p)).cast("bigint") for p in points for f in (F.floor, F.ceil)]))
    inner = F.col("_n") - F.col("_least") - F.col("_most")
    parts = F.array(
        _range(F.lit(-INFINITY), F.lit(-INFINITY), F.lit(0), F.col("_least")),
        _range(F.col("_lo"), F.col("_hi"), F.col("_least"), inner),
        _range(F.lit(INFINITY), F.lit(INFINITY), F.col("_n") - F.col("_most"), F.col("_most")),
    )
    ranges = sizes.select(*group, ranks.alias("_all_ranks"), F.inline(parts)).withColumn("_ranks", F.filter(
        "_all_ranks", lambda r: (r >= F.col("_below")) & (r < F.col("_below") + F.col("_rows"))
    ))
    ranges = ranges.filter("_rows > 0 and size(_ranks) > 0").select(*group, "_lo", "_hi", "_below", "_rows", "_ranks")
    while True:
        most = ranges.filter("_lo < _hi").agg(F.max("_rows")).first()[0]
        if most is None or most <= ordered:
            break
        ranges = materialize(_narrowed(values, ranges, group, buckets, ordered), "ranges")

    found = _found(values, ranges, group)
    at_rank = join_null_safe(found, sizes.select(*group, "_n"), group)

    def at(rank: Column) -> Column:
        return F.max(F.when(F.col("_rank") == rank, F.col("_v")))

    ends = [at(f(_position(p))).alias(f"_{name}{i}") for i, p in enumerate(points) for name, f in _ENDS]
    results = [
        _between(F.col(f"_low{i}"), F.col(f"_high{i}"), _position(p)).alias(_name(p)) for i, p in enumerate(points)
    ]
    return at_rank.groupBy(*group, "_n").agg(*ends).select(*keys, *results)


INFINITY = float("inf")


def _range(low: Column, high: Column, below: Column, rows: Column) -> Column:
    return F.struct(
        low.cast("double").alias("_lo"), high.cast("double").alias("_hi"), below.cast("bigint").alias("_below"),
        rows.cast("bigint").alias("_rows"),
    )


_ENDS = [("low", F.floor), ("high", F.ceil)]


def _between(low: Column, high: Column, position: Column) -> Column:
    """Equal ends are the value itself, also where they are infinite."""
    return F.when(low == high, low).otherwise(low + (high - low) * (position - F.floor(position)))


def _name(point: float) -> str:
    return f"p_{point:g}".replace(".", "_")


def _position(point: float) -> Column:
    return F.lit(float(point)) * (F.col("_n") - 1)


def _inside(values: DataFrame, ranges: DataFrame, group: list[str]) -> DataFrame:
    """Values with the range they lie in; ranges of a group do not overlap."""
    bounds = ranges.select(*group, "_lo", "_hi")
    return join_null_safe(values, bounds, group).filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))


def _cumulative(counted: DataFrame, ranges: DataFrame, group: list[str], order: str) -> DataFrame:
    """Add the rank of the first row of each piece of a range, and the range's wanted ranks in the piece."""
    window = Window.partitionBy(*group, "_lo").orderBy(order)
    before = counted.withColumn("_first", F.sum("_c").over(window) - F.col("_c"))
    joined = join_null_safe(before, ranges.select(*group, "_lo", "_below", "_ranks"), [*group, "_lo"])
    joined = joined.withColumn("_first", F.col("_first") + F.col("_below"))
    wanted = F.filter("_ranks", lambda r: (r >= F.col("_first")) & (r < F.col("_first") + F.col("_c")))
    return joined.withColumn("_ranks", wanted).filter(F.size("_ranks") > 0)


def _narrowed(values: DataFrame, ranges: DataFrame, group: list[str], buckets: int, ordered: int) -> DataFrame:
    """Replace every large range by those of its buckets that hold a wanted rank.

    Buckets are even on a signed logarithmic scale, so far outliers do not put all
    other values into one; where that scale cannot tell the ends apart they are even
    in the values.
    """
    large = (F.col("_lo") < F.col("_hi")) & (F.col("_rows") > ordered)

    def scale(name: str) -> Column:
        return F.signum(name) * F.log1p(F.abs(name))

    share = F.when(
        scale("_hi") > scale("_lo"), F.try_divide(scale("_v") - scale("_lo"), scale("_hi") - scale("_lo"))
    ).otherwise(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")))
    bucket = F.least(F.floor(share * F.lit(float(buckets))), F.lit(buckets - 1)).cast("int")
    counted = (
        _inside(values, ranges.filter(large), group)
        .groupBy(*group, "_lo", bucket.alias("_bucket"))
        .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    )
    chosen = _cumulative(counted, ranges.filter(large), group, "_bucket").select(
        *group, F.col("_min").alias("_lo"), F.col("_max").alias("_hi"), F.col("_first").alias("_below"),
        F.col("_c").alias("_rows"), "_ranks",
    )
    return chosen.unionByName(ranges.filter(~large))


def _found(values: DataFrame, ranges: DataFrame, group: list[str]) -> DataFrame:
    """The value at every wanted rank."""
    single = ranges.filter("_lo = _hi").select(*group, F.explode("_ranks").alias("_rank"), F.col("_lo").alias("_v"))
    spread = ranges.filter("_lo < _hi")
    counted = (
        _inside(values, spread, group).groupBy(*group, "_lo", "_v").agg(F.count(F.lit(1)).alias("_c"))
    )
    ordered = _cumulative(counted, spread, group, "_v").select(*group, F.explode("_ranks").alias("_rank"), "_v")
    return single.unionByName(ordered)
