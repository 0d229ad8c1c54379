"""Error tables. Groups are pre-aggregated on the map side; a global error is never an average of averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def errors(df: DataFrame, pred: Column, real: Column, groups: Sequence[str | Column]) -> DataFrame:
    """Per group: n, rmse, least and largest absolute error, Pearson r; rows with a missing side do not count."""
    both = df.withColumn("__p", pred).withColumn("__r", real).filter("__p IS NOT NULL AND __r IS NOT NULL")
    diff = F.col("__p") - F.col("__r")
    r = F.try_divide(F.covar_pop("__p", "__r"), F.stddev_pop("__p") * F.stddev_pop("__r"))  # null where a side is constant
    return both.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(diff * diff)).alias("rmse"),
        F.min(F.abs(diff)).alias("min_abs"), F.max(F.abs(diff)).alias("max_abs"), r.alias("r"),
    )


def long_form(df: DataFrame, keys: Sequence[str], measures: dict[str, Column], name: str = "model", value: str = "pred") -> DataFrame:
    """One row a measure: wide to long."""
    wide = df.select(*keys, *[c.alias(k) for k, c in measures.items()])
    return wide.unpivot(list(keys), list(measures), name, value)


def against_targets(preds: DataFrame, targets: DataFrame, keys: Sequence[str], name: str, atoms: Sequence[str], limits: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Predictions with ``<atom>_real``; null where names differ or the target is outside its hard range."""
    real = targets.select(*keys, F.col(name).alias("__name"), *[F.col(a).alias(f"{a}_real") for a in atoms])
    joined = preds.join(real, list(keys))
    out = {}
    for a in atoms:
        low, high = limits.get(a, (None, None))
        ok = F.col(name) == F.col("__name")
        if low is not None:
            ok = ok & (F.col(f"{a}_real") >= low)
        if high is not None:
            ok = ok & (F.col(f"{a}_real") <= high)
        out[f"{a}_real"] = F.when(ok, F.col(f"{a}_real"))
    return joined.withColumns(out).drop("__name")
