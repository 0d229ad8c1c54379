"""Spatial operators. A radius join is an equality join on grid cells with a residual distance test, never a nested loop."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residuum.functions import vectors as V
from residuum.session import stash


def _near_cells(xyz: Sequence[str], radius: float) -> list[Column]:
    """Along each axis the cells (of two radii) that a ball around the row reaches: one or two."""
    wide = lambda c: radius * (1 + 1e-9) + F.abs(F.col(c)) * 1e-14  # noqa: E731  rounding can't lose a cell
    return [F.array_distinct(F.array(*[F.floor((F.col(c) + move) / (2 * radius)) for move in (-wide(c), wide(c))])) for c in xyz]


def _met(own: DataFrame, other: DataFrame, radius: float, keys: Sequence[str], xyz: Sequence[str], prefix: str) -> DataFrame:
    """Rows of ``own`` (whose ``__c`` lists cells) with those of ``other`` in these cells that are within ``radius``."""
    on = [F.col(f"__c{i}") == F.col(f"__l{i}") for i in range(len(xyz))] + [F.col(k) == F.col(prefix + k) for k in keys]
    dist = F.sqrt(sum(((F.col(c) - F.col(prefix + c)) * (F.col(c) - F.col(prefix + c)) for c in xyz), F.lit(0.0)))
    # the cells' rows are many times the table's, which the planner doesn't see: never a broadcast
    pairs = own.hint("merge").join(other.hint("merge"), on).withColumn("dist", dist).filter(F.col("dist") <= radius)
    return pairs.drop(*[f"__l{i}" for i in range(len(xyz))], *[f"__c{i}" for i in range(len(xyz))])


def radius_join(left: DataFrame, right: DataFrame, radius: float, keys: Sequence[str] = (), xyz: Sequence[str] = ("x", "y", "z"), prefix: str = "o_") -> DataFrame:
    """Pairs within ``radius`` (inclusive) that share ``keys``; columns of the right side get ``prefix``; ``dist`` is added.

    Cells are two radii wide, and the left side is put into the at most eight that its ball reaches; the right side stays one row each. Rows without coordinates drop out.
    """
    own = left.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in xyz]))
    for i, cells in enumerate(_near_cells(xyz, radius)):
        own = own.withColumn(f"__c{i}", F.explode(cells))
    other = right.select(*[F.col(c).alias(prefix + c) for c in right.columns])
    other = other.withColumns({f"__l{i}": F.floor(F.col(prefix + c) / (2 * radius)) for i, c in enumerate(xyz)})
    return _met(own, other, radius, keys, xyz, prefix)


#: Points in a cell, on average over the points, that the first step of a search for nearest rows starts from.
IN_A_CELL = 16


def nearest(left: DataFrame, right: DataFrame, radius: float, row: Sequence[str], order: Sequence[str], n: int = 1, valid: Column | None = None, keys: Sequence[str] = (), xyz: Sequence[str] = ("x", "y", "z"), prefix: str = "o_") -> DataFrame:
    """Of each row's pairs within ``radius`` that are ``valid`` the ``n``-th by distance, then ``order``; the columns of ``radius_join``.

    Steps of doubling radius: a row that has ``n`` valid pairs within a step's radius has its nearest among them, so only the others go on. The first
    radius is one whose cells hold few points, so work follows the points and not their pairs, however dense they lie. ``row`` names rows of the left side.
    """
    steps = _steps(right, radius, keys, xyz)
    open_, found = left, []
    for k, reach in enumerate(steps):
        pairs = radius_join(open_, right, reach, keys, xyz, prefix)
        pairs = pairs if valid is None else pairs.filter(valid)
        ranked = F.row_number().over(Window.partitionBy(*row).orderBy("dist", *order))
        step = pairs.withColumn("__n", ranked).filter(F.col("__n") == n).drop("__n")
        if k < len(steps) - 1:
            step = stash(step, "nearest")
            open_ = stash(open_.join(step.select(*row), list(row), "left_anti"), "nearest-open")
        found.append(step)
    return reduce(DataFrame.unionByName, found)


def _steps(points: DataFrame, radius: float, keys: Sequence[str], xyz: Sequence[str]) -> list[float]:
    """Radii that double up to ``radius``, from the largest whose cells hold few points."""
    total = points.count()
    halves = 0
    while 8**halves * IN_A_CELL < total:
        halves += 1
    reach = [radius / 2**k for k in range(halves + 1)]
    cells = F.array(*[F.struct(F.lit(k).alias("__k"), *[F.floor(F.col(c) / (2 * r)).alias(f"__l{i}") for i, c in enumerate(xyz)]) for k, r in enumerate(reach)])
    counts = points.select(*keys, F.inline(cells)).groupBy(*keys, "__k", *[f"__l{i}" for i in range(len(xyz))]).agg(F.count(F.lit(1)).alias("__m"))
    crowd = {r["__k"]: r["m"] for r in counts.groupBy("__k").agg(F.sum(F.col("__m") * F.col("__m")).alias("m")).collect()}
    first = next((k for k in range(halves + 1) if crowd.get(k, 0) <= IN_A_CELL * total), halves)
    return reach[first::-1]


def first_valid(pairs: DataFrame, row: Sequence[str], valid: Column, order: Sequence[str]) -> DataFrame:
    """Of each row's candidates the first that satisfies ``valid``: what a search that excludes and retries ends with."""
    w = Window.partitionBy(*row).orderBy(*order)
    return pairs.filter(valid).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def nth_nearest(pairs: DataFrame, row: Sequence[str], order: Sequence[str], n: int = 1) -> DataFrame:
    w = Window.partitionBy(*row).orderBy(*order)
    return pairs.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") == n).drop("__n")


def contact_sum(pairs: DataFrame, row: Sequence[str], shift: float = 1.2, name: str = "contact") -> DataFrame:
    """Sum over neighbours of exp(shift - distance)."""
    return pairs.groupBy(*row).agg(F.sum(F.exp(shift - F.col("dist"))).alias(name))


def half_sphere(pairs: DataFrame, row: Sequence[str], direction: Column) -> DataFrame:
    """Neighbours in the half sphere that ``direction`` (a dot product) points to, and in the other."""
    return pairs.groupBy(*row).agg(F.count_if(direction > 0).alias("up"), F.count_if(direction <= 0).alias("down"))


#: Atoms and corners of rings in one block, and the pairs of them that are worked out at a time.
TARGETS, CORNERS, AT_ONCE = 8_192, 16_384, 65_536


def _blocks(df: DataFrame, keys: Sequence[str], most: int, salt: Sequence[str], name: str) -> DataFrame:
    """``df`` with the number of a block of about ``most`` rows within ``keys``, by a hash of ``salt``."""
    counts = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).alias("__blocks"))
    return df.join(counts, list(keys)).withColumn(name, F.pmod(F.xxhash64(*salt), F.col("__blocks")).cast("int")).drop("__blocks")


def ring_current(atoms: DataFrame, rings: DataFrame, keys: Sequence[str], row: Sequence[str], intensity: Column, factor: Column) -> DataFrame:
    """``row, ring``: over all rings of the structure the sum of intensity * factor * signed area * (1/r_i^3 + 1/r_j^3) over edges.

    ``atoms`` has x, y, z and the columns of ``factor``; ``rings`` has those of ``intensity`` and ``ring``, an array of struct<x,y,z> in order around the ring. Areas are of the
    triangles that the atom's projection to the ring plane spans with each edge, signed by the plane's normal n.

    With d from corner c to the atom, both edges at c come to d . (before - after) x n / 2 times 1/|d|^3, so each corner is a source of six numbers, and nothing is projected. Blocks of
    atoms meet blocks of corners of their structure; their sums, one an atom and block, are added up. All pairs of a structure are worked out: that is quadratic in its size, in bounded memory.
    """
    at = lambda k: V.vec(F.get(F.col("ring"), F.lit(k)))
    raw = V.cross(V.sub(at(1), at(0)), V.sub(V.vec(F.element_at("ring", -1)), at(0)))
    size = V.norm(raw)
    # a ring without a plane, or with a corner that has no place, adds nothing
    whole = F.coalesce((size > 0) & ~F.exists("ring", lambda p: p["x"].isNull() | p["y"].isNull() | p["z"].isNull()), F.lit(False))
    planes = rings.select(*keys, "ring", intensity.cast("double").alias("__i"), whole.alias("__whole"), *[F.try_divide(c, size).alias(f"__n{a}") for c, a in zip(raw, "xyz")])
    turned = lambda first, rest: F.concat(first, rest)
    n = F.size("ring")
    before, after = turned(F.slice("ring", n, F.lit(1)), F.slice("ring", F.lit(1), n - 1)), turned(F.slice("ring", F.lit(2), n - 1), F.slice("ring", 1, 1))
    each = planes.select(*keys, "__i", "__whole", "__nx", "__ny", "__nz", F.inline(F.arrays_zip(F.col("ring").alias("c"), before.alias("b"), after.alias("a"))))
    pull = V.cross(V.sub(V.vec("b"), V.vec("a")), V.columns("__nx", "__ny", "__nz"))
    source = F.array(*V.vec("c"), *[F.col("__i") * g / 2 for g in pull])
    corners = each.select(*keys, "c", F.when(F.col("__whole") & F.col("__i").isNotNull(), source).alias("source"))
    corners = _blocks(corners, keys, CORNERS, ["c", "source"], "__s").groupBy(*keys, "__s").agg(F.collect_list("source").alias("__sources"))  # of valid ones; at most a block
    rows = atoms.select(*keys, F.struct(*row).alias("__row"), F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("z").cast("double").alias("z"), factor.cast("double").alias("f")).alias("at"))
    targets = _blocks(rows, keys, TARGETS, ["__row"], "__t").groupBy(*keys, "__t").agg(F.collect_list(F.struct("__row", "at")).alias("__targets"))

    @F.pandas_udf("array<double>")
    def run(at: pd.Series, sources: pd.Series) -> pd.Series:
        def one(a: np.ndarray, s: np.ndarray) -> np.ndarray:
            if not len(s):
                return np.full(len(a), None)
            p = np.array([[np.nan if r[c] is None else r[c] for c in "xyzf"] for r in a], float)
            q = np.stack(s).astype(float)
            out = np.zeros(len(p))
            step = max(1, AT_ONCE // 2048)
            for i in range(0, len(p), step):
                some = p[i : i + step]
                for j in range(0, len(q), 2048):
                    x, y, z, gx, gy, gz = q[j : j + 2048].T
                    dx, dy, dz = some[:, 0, None] - x, some[:, 1, None] - y, some[:, 2, None] - z
                    far = dx * dx + dy * dy + dz * dz
                    pulled = dx * gx + dy * gy + dz * gz
                    cube = far * np.sqrt(far)
                    cube[cube == 0] = np.inf  # a corner exerts nothing on itself
                    out[i : i + step] += (pulled / cube).sum(1)
            out *= p[:, 3]
            return np.where(np.isnan(out), None, out)

        return pd.Series([one(a, s) for a, s in zip(at, sources)])

    met = targets.hint("merge").join(corners.hint("merge"), list(keys)).repartition(*keys, "__t", "__s")
    met = met.select("__targets.__row", run("__targets.at", "__sources").alias("__v"))
    sums = met.select(F.inline(F.arrays_zip(F.col("__row").alias("r"), F.col("__v").alias("v"))))
    return sums.select("r.*", "v").groupBy(*row).agg(F.sum("v").alias("ring"))


def disulfides(sulfurs: DataFrame, keys: Sequence[str], number: str, reach: float = 2.5, apart: int = 4) -> DataFrame:
    """Pairs of sulfur atoms within ``reach`` whose residue numbers are ``apart`` or more apart."""
    pairs = radius_join(sulfurs, sulfurs, reach, keys)
    return pairs.filter(F.abs(F.col(number) - F.col(f"o_{number}")) >= apart)
