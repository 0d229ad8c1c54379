"""Exact quantiles without a group in one task: distinct values are counted, sorted in ranges, and ranks are running counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from residuum.session import stash


#: Different values (by group) that are ranked in one step; more are ranked in ranges.
FEW = 100_000


def _in_ranges(counts: DataFrame, keys: list[str], by) -> DataFrame:
    """``counts`` with ``__upto`` and ``__all``, the rank of each value's last row and its group's size: ranges hold any part of a group, and only sums by range and group are added up."""
    ranged = stash(counts.repartitionByRange(*keys, "__v").withColumn("__part", F.spark_partition_id()), "ranks")
    sums = ranged.groupBy(*keys, "__part").agg(F.sum("__n").alias("__sum"))
    before = by.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(f"__o_{k}") for k in keys], F.col("__part").alias("__o_part"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"), F.sum("__sum").over(by).alias("__all"))
    same = [F.col(k).eqNullSafe(F.col(f"__o_{k}")) for k in keys] + [F.col("__part") == F.col("__o_part")]
    within = Window.partitionBy("__part", *keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(offsets, same).withColumn("__upto", F.col("__before") + F.sum("__n").over(within))


def quantiles(df: DataFrame, value: str, shares: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """``groups, share, quantile``, interpolated between neighbours; no row for a group without values.

    Values are counted before they are shuffled; where there are few different ones, whatever the rows, a window ranks them, else ranges do.
    """
    keys = list(groups)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    counts = stash(counts, "rank-counts")
    by = Window.partitionBy(*(keys or [F.lit(0)]))
    if counts.limit(FEW + 1).count() <= FEW:
        upto = by.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
        rows = counts.withColumns({"__upto": F.sum("__n").over(upto), "__all": F.sum("__n").over(by)})
    else:
        rows = _in_ranges(counts, keys, by)
    each = rows.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("__h", (F.col("__all") - 1) * F.col("share"))
    holds = lambda rank: (rank < F.col("__upto")) & (rank >= F.col("__upto") - F.col("__n"))
    low, high = F.floor("__h"), F.ceil("__h")
    found = each.filter(holds(low) | holds(high)).groupBy(*keys, "share").agg(F.max(F.when(holds(low), F.col("__v"))).alias("__a"), F.max(F.when(holds(high), F.col("__v"))).alias("__b"), F.max(F.col("__h") - low).alias("__f"))
    return found.select(*keys, "share", (F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__f")).alias("quantile"))
