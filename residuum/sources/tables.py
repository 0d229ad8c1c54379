"""Tables of many files, with schemas stated rather than inferred."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from residuum.operators.curate import only_if_unique


def read_csv(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def union(tables: list[DataFrame]) -> DataFrame:
    """All rows, columns by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_csv(table: DataFrame, path: str) -> None:
    table.write.csv(path, header=True)


def unambiguous(files: DataFrame, key: str) -> DataFrame:
    """Files whose key names no other file; a join on it leaves the rest at their defaults."""
    return only_if_unique(files, [key])
