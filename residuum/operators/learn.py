"""Learning on Spark: out-of-fold means, stacked models with a fallback. The first level is grown by ``trees``, the second by pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.operators import keys as K
from residuum.operators import trees as randomised


def out_of_fold_means(df: DataFrame, group: Sequence[str], fold: str, value: str, name: str = "oof") -> DataFrame:
    """Mean of the group over the other folds, from sums by (group, fold) alone; a null group is a group, a null fold a fold."""
    parts = df.groupBy(*group, fold).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    whole = parts.groupBy(*group).agg(F.sum("__s").alias("__all_s"), F.sum("__n").alias("__all_n"))
    rest = F.col("__all_n") - F.col("__n")
    means = K.join(parts, whole, group).select(*group, fold, F.when(rest > 0, (F.col("__all_s") - F.coalesce("__s", F.lit(0))) / rest).alias(name))
    return K.join(df, means, [*group, fold])


def assembled(df: DataFrame, features: Sequence[str], into: str = "features") -> DataFrame:
    """Features in the order given, which is part of the model; rows with a missing one are dropped."""
    return VectorAssembler(inputCols=list(features), outputCol=into, handleInvalid="skip").transform(df)


def forest(label: str, trees: int = 500, subset: str = "0.3", leaf: int = 3, depth: int = 30, seed: int = 1, bootstrap: bool = False) -> RandomForestRegressor:
    """Trees on all rows, without bootstrap unless asked for; as deep as the leaf size lets them be, up to the library's limit of 30."""
    return RandomForestRegressor(featuresCol="features", labelCol=label, predictionCol="pred", numTrees=trees, featureSubsetStrategy=subset, minInstancesPerNode=leaf, maxDepth=depth, seed=seed, bootstrap=bootstrap)


def stack(df: DataFrame, features: Sequence[str], label: str, fold: str, k: int, transferred: Sequence[str], trees: int = 500, depth: int = 30, seed: int = 1) -> dict[str, randomised.Forest | RandomForestRegressionModel]:
    """Three models: R0 on the features, extremely randomised trees; R1 on those and R0's out-of-fold prediction; R2 also on what was transferred, where it exists.

    R0's folds and its model of all rows are grown together. R1 and R2 are random forests without bootstrap.
    """
    r0 = randomised.fit(df, features, label, trees, subset=0.3, leaf=3, split=15, depth=2 * depth, seed=seed, fold=fold, folds=k)
    joined = randomised.predict(df, r0, "r0_pred", fold)
    level_1 = forest(label, trees, subset="0.5", leaf=7, depth=depth, seed=seed)  # a leaf of 7 asks for 14 rows to split, more than the 12 that were asked
    full = joined.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in transferred]))
    return {"r0": r0, "r1": level_1.fit(assembled(joined, [*features, "r0_pred"])), "r2": level_1.fit(assembled(full, [*features, *transferred, "r0_pred"]))}


def fallback(valid: Column, combined: Column, alone: Column, base: Column) -> Column:
    """The combined model where its inputs are valid, else the feature model; plus the baseline."""
    return F.coalesce(F.when(valid, combined), alone) + base
