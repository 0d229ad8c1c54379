"""Joins on keys that may be null: a null key is a key of its own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``right`` where all ``keys`` are equal or both null; the keys appear once, as ``left``'s."""
    named = right.select(*[F.col(f"`{c}`").alias(f"__right_{c}") if c in keys else F.col(f"`{c}`") for c in right.columns])
    joined = left.join(named, [F.col(f"`{k}`").eqNullSafe(F.col(f"`__right_{k}`")) for k in keys], how)
    return joined.drop(*[f"__right_{k}" for k in keys])
