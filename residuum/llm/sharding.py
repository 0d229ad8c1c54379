"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

In a uniform random permutation of N rows that are held by P partitions and cut into S shards, the number of rows that go
from partition p to shard s follows a multivariate hypergeometric law. The matrix of those counts is drawn first (P x S
numbers, seeded), then each partition permutes its rows and cuts them by its row of the matrix, rows are exchanged, and
each shard permutes what it got. Shard sizes are exact by construction and reruns agree.

Partitions are logical, by a hash of the row, so that a recomputed task after a lost executor deals the same rows.
Draws are exact at any size. Defined cases. Nulls hash as such; maps are told apart by their JSON. Identical rows get an ordinal within their partition, or, where there are very many, in all, and are spread like any others.
Fewer rows than shards: the first shards hold one row each. Empty table: empty result. Input columns named like the two
results are replaced.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residuum.llm.common import stash

SHARDS = 16
#: The most rows whose copies are counted apart, so that they can be broadcast.
MOST_HOT = 100_000
SEED = 20
#: Rows that one task permutes; and the most logical partitions, which bounds the matrix (65,536 x 16 numbers are 8 MB).
ROWS_A_TASK = 5_000
MOST_PARTITIONS = 65_536


def exact_sizes(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def communication_matrix(held: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows: partitions, columns: shards; row sums are ``held``, column sums are ``sizes``."""
    rng, left, matrix = np.random.Generator(np.random.PCG64(seed)), list(sizes), []
    for n in held:
        row, need, pool = [], n, sum(left)
        for s, have in enumerate(left):
            pool -= have
            x = need if not pool else 0 if not need or not have else _draw(rng, have, pool, need)
            row.append(x)
            left[s] -= x
            need -= x
        matrix.append(row)
    return matrix


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn without replacement are of the ``good``."""
    # numpy's sampler takes less than 10**9 of either kind
    return int(rng.hypergeometric(good, bad, n)) if max(good, bad) < 10**9 else _ratio_of_uniforms(rng, good, bad, n)


def _ratio_of_uniforms(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """The same law at any size: Stadlober's rejection from a ratio of uniforms, with probabilities that keep a double's precision."""
    if 2 * n > good + bad:
        return good - _ratio_of_uniforms(rng, good, bad, good + bad - n)
    if good > bad:
        return n - _ratio_of_uniforms(rng, bad, good, n)
    all_ = good + bad
    p = good / all_
    spread = (n * p * (1 - p) * ((all_ - n) / (all_ - 1)) + 0.5) ** 0.5
    top = log_share((n + 1) * (good + 1) // (all_ + 2), good, bad, n)
    while True:
        u, v = 1 - rng.random(), rng.random()
        x = math.floor(n * p + 0.5 + (HAT * spread + HAT_MORE) * (v - 0.5) / u)
        if max(0, n - bad) <= x <= min(n, good) and 2 * math.log(u) <= log_share(x, good, bad, n) - top:
            return x


#: Constants of the hat: 2 * sqrt(2 / e) and 3 - 2 * sqrt(3 / e).
HAT, HAT_MORE = 2 * (2 / math.e) ** 0.5, 3 - 2 * (3 / math.e) ** 0.5


def log_share(x: int, good: int, bad: int, n: int) -> float:
    """Log of the hypergeometric probability, from three binomial ones in saddle-point form: no large logarithms are subtracted."""
    all_ = good + bad
    p, q = n / all_, (all_ - n) / all_
    return _log_binomial(x, good, p, q) + _log_binomial(n - x, bad, p, q) - _log_binomial(n, all_, p, q)


def _log_binomial(x: int, n: int, p: float, q: float) -> float:
    if x == 0 or x == n:
        return 0.0 if n == 0 else n * (math.log1p(-p) if x == 0 and p < 0.5 else math.log(q) if x == 0 else math.log(p))
    rest = _stirling(n) - _stirling(x) - _stirling(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
    return rest + 0.5 * (math.log(n / (2 * math.pi * x)) - math.log((n - x)))


def _stirling(n: int) -> float:
    """log n! less Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * n * n)) / (n * n)) / (n * n)) / n


def _deviance(x: int, mean: float) -> float:
    """x log(x / mean) + mean - x, by a series where x is near the mean."""
    v = (x - mean) / (x + mean)
    if abs(v) >= 0.1:
        return x * math.log(x / mean) + mean - x
    total, power, k = (x - mean) * v, 2 * x * v, 1
    while True:
        power *= v * v
        more = total + power / (2 * k + 1)
        if more == total:
            return total
        total, k = more, k + 1


def shuffle_into_shards(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1, sizes at most one apart) and ``slot`` (0, 1, ... within the shard)."""
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot")
    total = rows.count()
    parts = max(1, min(MOST_PARTITIONS, -(-total // rows_a_task)))
    blocks = max(1, min(MOST_PARTITIONS // shards, -(-total // (shards * rows_a_task))))
    names = rows.columns
    # maps can't be hashed or grouped: their JSON stands for them
    maps = [f.name for f in rows.schema if "map<" in f.dataType.simpleString()]
    told = [F.to_json(F.struct(F.col(f"`{c}`"))) if c in maps else F.col(f"`{c}`") for c in names]
    hashed = rows.select("*", F.xxhash64(F.lit(seed), *told).alias("__r"))
    # copies of a row share a hash: those of a row with very many are counted first and spread by their number
    many = max(rows_a_task // 5, total // MOST_HOT)
    hot = stash(hashed.groupBy("__r").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > many).select("__r"), "shard-hot")
    if not hot.isEmpty():
        each = [c.alias(f"__c{k}") for k, c in enumerate(told)]
        counted = hashed.join(F.broadcast(hot), "__r", "left_semi").groupBy(*each, "__r").agg(F.count(F.lit(1)).alias("__n"), *[F.first(f"`{c}`").alias(f"__m{k}") for k, c in enumerate(names) if c in maps])
        counted = counted.select(*[F.col(f"__m{k}" if c in maps else f"__c{k}").alias(c) for k, c in enumerate(names)], "__r", "__n")
        # written out in two steps, so that no task makes many copies by itself
        some = counted.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(rows_a_task).cast("long")))).repartition("__r", "__from")
        copies = some.withColumn("__k", F.explode(F.sequence(F.col("__from") + 1, F.least(F.col("__n"), F.col("__from") + rows_a_task))))
        copies = copies.select(*[F.col(f"`{c}`") for c in names], F.xxhash64("__r", "__k").alias("__r"))
        hashed = hashed.join(F.broadcast(hot), "__r", "left_anti").unionByName(copies)
    hashed = hashed.withColumn("__p", F.pmod(F.xxhash64("__r", F.lit(1)), F.lit(parts)).cast("int"))
    held = {r["__p"]: r["n"] for r in hashed.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect()}  # one number a partition
    matrix = communication_matrix([held.get(p, 0) for p in range(parts)], exact_sizes(total, shards), seed)
    bounds = [(p, [int(x) for x in np.cumsum(row)]) for p, row in enumerate(matrix)]
    cuts = spark.createDataFrame(bounds, T.StructType([T.StructField("__p", T.IntegerType()), T.StructField("__cuts", T.ArrayType(T.LongType()))]))
    # permute within the partition: identical rows are told apart by an ordinal
    local = hashed.repartition(F.col("__p")).withColumn("__k", F.row_number().over(Window.partitionBy("__p", "__r").orderBy("__r")))
    local = local.withColumn("__at", F.row_number().over(Window.partitionBy("__p").orderBy(F.xxhash64("__r", "__k", F.lit(2)), "__r", "__k")))
    sent = local.join(F.broadcast(cuts), "__p").withColumn("shard", F.size(F.filter("__cuts", lambda c: c < F.col("__at"))))
    # permute again within the shard, in blocks of bounded size
    sent = sent.withColumn("__q", F.xxhash64("__r", "__k", F.lit(3))).withColumn("__b", F.pmod(F.xxhash64("__q", F.lit(4)), F.lit(blocks)).cast("int"))
    filled = sent.groupBy("shard", "__b").agg(F.count(F.lit(1)).alias("__n"))
    first = filled.select("shard", "__b", F.coalesce(F.sum("__n").over(Window.partitionBy("shard").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    slot = F.col("__first") + F.row_number().over(Window.partitionBy("shard", "__b").orderBy("__q", "__r", "__k")) - 1
    # both tables have at most MOST_PARTITIONS rows
    return sent.join(F.broadcast(first), ["shard", "__b"]).select(*[F.col(f"`{c}`") for c in names], "shard", slot.cast("long").alias("slot"))
