"""Curation of labels and features: outliers, imputation, exclusion lists, duplicates, guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residuum.operators import keys as K
from residuum.operators.ranks import quantiles


def outliers(df: DataFrame, value: str, k: float = 5.0, groups: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``is_outlier``: outside mean +- k sample standard deviations of its group (nulls never are; a null group is a group).

    Statistics come from one pre-aggregated row a group and are joined back.
    """
    keys = list(groups)
    stats = df.groupBy(*keys).agg(F.avg(value).alias("__mean"), F.stddev_samp(value).alias("__sd"))
    joined = K.join(df, stats, keys) if keys else df.crossJoin(F.broadcast(stats))  # one row without groups
    return joined.withColumn("is_outlier", F.coalesce(F.abs(F.col(value) - F.col("__mean")) > k * F.col("__sd"), F.lit(False))).drop("__mean", "__sd")


def medians(train: DataFrame, names: Sequence[str], skip_zero: bool = True) -> DataFrame:
    """One row: the median of each column over its non-zero (or all) values, null without any."""
    kept = lambda n: F.when(F.col(n) != 0, F.col(n)) if skip_zero else F.col(n)
    long = train.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), kept(n).cast("double").alias("value")) for n in names])).alias("p")).select("p.*")
    found = quantiles(long, "value", [0.5], ["name"])
    return found.agg(*[F.max(F.when(F.col("name") == n, F.col("quantile"))).alias(n) for n in names])


def impute(df: DataFrame, fitted: DataFrame, zero: bool = True) -> DataFrame:
    """Zeros (or nulls) become the fitted medians."""
    names = fitted.columns
    one = fitted.select(*[F.col(n).alias(f"__m_{n}") for n in names])
    missing = lambda n: (F.col(n) == 0) if zero else F.col(n).isNull()
    return df.crossJoin(F.broadcast(one)).withColumns({n: F.when(missing(n), F.col(f"__m_{n}")).otherwise(F.col(n)) for n in names}).drop(*one.columns)  # one row


def exclude(df: DataFrame, listed: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Null ``names`` on rows whose keys are listed; keys compare as columns, never as a joined string."""
    flags = listed.select(*keys).distinct().withColumn("__listed", F.lit(True))
    joined = K.join(df, flags, keys, "left")
    return joined.withColumns({n: F.when(F.col("__listed").isNull(), F.col(n)) for n in names}).drop("__listed")


def only_if_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not ambiguous; a null key is one like any other."""
    single = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n = 1").drop("__n")
    return K.join(df, single, keys, "left_semi")


def last_wins(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def first_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def check_order(df: DataFrame, keys: Sequence[str], position: str, number: str) -> DataFrame:
    """``df``; evaluating it fails if a number repeats or falls along the position."""
    w = Window.partitionBy(*keys).orderBy(position)
    wrong = F.lag(number).over(w) >= F.col(number)
    return df.withColumn(number, F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(F.lit(f"{number} repeats or is out of order"))).otherwise(F.col(number)))


def pivot_labels(df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Long to wide with a fixed list of names, so that no pass looks for them."""
    return df.groupBy(*keys).pivot(name, list(names)).agg(F.max(value))


def whiten(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(x - mean) / sample standard deviation of each column."""
    stats = df.agg(*[f(n).alias(f"__{k}_{n}") for n in names for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    joined = df.crossJoin(F.broadcast(stats))  # one row
    return joined.withColumns({n: (F.col(n) - F.col(f"__m_{n}")) / F.col(f"__s_{n}") for n in names}).drop(*stats.columns)


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    return df.groupBy(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles of each group."""
    keys = list(groups)
    stats = df.groupBy(*keys).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    named = {0.25: "q25", 0.5: "q50", 0.75: "q75"}
    found = quantiles(df, value, list(named), keys).groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(*[F.max(F.when(F.col("share") == s, F.col("quantile"))).alias(n) for s, n in named.items()])
    joined = stats.join(found, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], "left") if keys else stats.crossJoin(F.broadcast(found))  # one row without groups
    return joined.select(*keys, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """``df``; evaluating a row that breaks the condition fails."""
    return df.filter(F.when(condition, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
