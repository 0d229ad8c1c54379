"""Extremely randomised regression trees, grown level by level for all trees and folds at once.

A node that is large enough draws some features and, for each, one cut uniformly between the node's extremes; the cut that lowers the squared error
most, with enough rows on both sides, splits it. There is no bootstrap. Two passes over the rows serve a level of every tree of every fold: the first
finds each open node's extremes, the second what lies left of each drawn cut. A fold's trees leave its rows out by a mask, so K folds and the model of
all rows share their passes.

Draws are hashes of seed, tree and path, not of what grows beside: the trees of a fold are those of a fit without its rows, whatever the partitions.

At scale: rows stay where they are and are read in batches; a task adds up its own and sends one row an open node. Open nodes are taken in slices, so
that a task's sums stay below ``SLICE_BYTES``. The trees themselves are held by the driver and go to the tasks, as they do for any forest: depth and least rows bound them.
Rows without a label or with a missing feature are left out of a fit; a row with a missing feature has no prediction.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from residuum.session import stash

#: Bytes of sums that a task holds in a pass, and numbers that it works on at a time.
SLICE_BYTES, AT_ONCE = 128_000_000, 10_000_000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of numbers (the finaliser of splitmix64)."""
    x = (x + U(0x9E3779B97F4A7C15)).astype(U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def draw(keys: np.ndarray, low: np.ndarray, high: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each node the features to try (-1: none) and a cut of each: the first ``most`` in a random order, without those that are constant in the node; if
    all are, the next that isn't."""
    n, width = low.shape
    hashed = mix(keys[:, None] ^ mix(np.arange(width, dtype=U))[None])
    order = np.argsort(hashed, axis=1, kind="stable")
    varies = np.take_along_axis(low < high, order, 1)
    first = np.argmax(varies, 1)
    tried = order[:, :most].copy()
    tried[~varies[:, :most]] = -1
    none = ~varies[:, :most].any(1) & varies.any(1)
    tried[none, 0] = order[none, first[none]]
    share = (mix(np.take_along_axis(hashed, np.maximum(tried, 0), 1)) >> U(11)).astype(np.float64) / 2.0**53
    a, b = np.take_along_axis(low, np.maximum(tried, 0), 1), np.take_along_axis(high, np.maximum(tried, 0), 1)
    cut = a + share * (b - a)
    return tried.astype(np.int32), np.where(cut >= b, a, cut)


@dataclass(frozen=True)
class Forest:
    """Trees of ``groups``: one for each fold that is left out, and -1 for all rows. A node's right child follows its left one; -1: a leaf."""

    names: tuple[str, ...]
    groups: tuple[int, ...]
    trees: int
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    rows: np.ndarray

    def leaves(self, x: np.ndarray, roots: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree."""
        at = np.broadcast_to(roots, (len(x), len(roots))).copy()
        row = np.arange(len(x))[:, None]
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            right = x[row, np.maximum(f, 0)] > self.cut[at]
            at = np.where(inner, self.left[at] + right, at)

    def roots(self, group: int) -> np.ndarray:
        at = self.groups.index(group) * self.trees
        return np.arange(at, at + self.trees)


def _features(names: Sequence[str]) -> Column:
    return F.array(*[F.col(f"`{n}`").cast("double") for n in names])


def _missing(names: Sequence[str]) -> Column:
    return F.exists(_features(names), lambda v: v.isNull() | F.isnan(v))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def fit(df: DataFrame, names: Sequence[str], label: str, trees: int = 500, subset: float = 0.3, leaf: int = 3, split: int = 15, depth: int = 60, seed: int = 1, fold: str | None = None, folds: int = 0) -> Forest:
    """Trees on all rows and, with ``fold``, of each of ``folds`` numbers without its rows (a row whose fold is null is in all of them)."""
    names, groups = tuple(names), (*range(folds if fold else 0), -1)
    kept = df.select(_features(names).alias("x"), F.col(f"`{label}`").cast("double").alias("y"), (F.coalesce(F.col(f"`{fold}`").cast("int"), F.lit(-2)) if fold else F.lit(-2)).alias("g"), _missing(names).alias("bad"))
    rows = stash(kept.filter("NOT bad AND y IS NOT NULL AND NOT isnan(y)").drop("bad"), "tree-rows")
    many, most = len(groups) * trees, max(1, int(subset * len(names)))
    forest = Forest(names, groups, trees, np.full(many, -1, np.int32), np.zeros(many), np.zeros(many, np.int32), np.zeros(many), np.zeros(many, np.int64))
    tree_keys = mix(np.arange(trees, dtype=U) ^ mix(np.array([seed], U)))
    open_, keys = np.arange(many), np.tile(tree_keys, len(groups))
    owner = np.arange(many)  # the tree that a node is of
    a_slice = max(1, SLICE_BYTES // (16 * len(names) + 16 * most + 48))
    for level in range(depth + 1):
        if not len(open_):
            break
        found, tried, cuts = [np.concatenate(p) for p in zip(*[_extremes(rows, forest, open_[k : k + a_slice], owner, keys[k : k + a_slice], most) for k in range(0, len(open_), a_slice)])]
        forest.value[open_] = found["sum"] / np.maximum(found["n"], 1)
        forest.rows[open_] = found["n"]
        go = (found["n"] >= max(split, 2 * leaf)) & (found["low"] < found["high"]) & (tried >= 0).any(1)
        if level == depth or not go.any():
            break
        open_, keys, tried, cuts, found = open_[go], keys[go], tried[go], cuts[go], found[go]
        sides = [np.concatenate(p) for p in zip(*[_sides(rows, forest, open_[k : k + a_slice], owner, tried[k : k + a_slice], cuts[k : k + a_slice]) for k in range(0, len(open_), a_slice)])]
        n, total = found["n"][:, None], found["sum"][:, None]
        less, less_sum = sides
        fits = (tried >= 0) & (less >= leaf) & (n - less >= leaf)
        gain = np.where(fits, less_sum**2 / np.maximum(less, 1) + (total - less_sum) ** 2 / np.maximum(n - less, 1), -np.inf)
        best = np.argmax(gain, 1)
        at = np.arange(len(best))
        good = fits[at, best]
        open_, keys, best, at = open_[good], keys[good], best[good], at[good]
        left = len(forest.feature) + 2 * np.arange(len(open_))
        forest.feature[open_], forest.cut[open_], forest.left[open_] = tried[at, best], cuts[at, best], left
        # children: those too small to be split have their value already
        counts = np.stack([less[at, best], n[at, 0] - less[at, best]], 1).ravel()
        sums = np.stack([less_sum[at, best], total[at, 0] - less_sum[at, best]], 1).ravel()
        more = len(counts)
        forest = replace(
            forest, feature=np.append(forest.feature, np.full(more, -1, np.int32)), cut=np.append(forest.cut, np.zeros(more)), left=np.append(forest.left, np.zeros(more, np.int32)),
            value=np.append(forest.value, sums / np.maximum(counts, 1)), rows=np.append(forest.rows, counts.astype(np.int64)),
        )
        owner = np.append(owner, np.repeat(owner[open_], 2))
        children = np.stack([left, left + 1], 1).ravel()
        child_keys = mix(np.repeat(keys, 2) * U(2) + np.tile(np.array([0, 1], U), len(keys)))
        large = counts >= max(split, 2 * leaf)
        open_, keys = children[large], child_keys[large]
    return forest


def _slots(forest: Forest, open_: np.ndarray, owner: np.ndarray):
    """A function of rows and folds that gives (row, slot) of those in open nodes, sorted by slot; ``slot``: place in ``open_``."""
    slot_of = np.full(len(forest.feature), -1, np.int64)
    slot_of[open_] = np.arange(len(open_))
    models = np.unique(owner[open_])
    leaves_out = np.repeat(forest.groups, forest.trees)[models]

    def find(x: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = slot_of[forest.leaves(x, models)]
        slot[(fold[:, None] == leaves_out[None]) & (leaves_out[None] >= 0)] = -1
        row, column = np.nonzero(slot >= 0)
        slot = slot[row, column]
        order = np.argsort(slot, kind="stable")
        return row[order], slot[order]

    return find, max(1, AT_ONCE // (len(models) * (len(forest.names) + 4)))


def _each(batches: Iterator[pa.RecordBatch], width: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for k in range(0, batch.num_rows, step):
            part = batch.slice(k, step)
            yield _matrix(part, width), part.column(1).to_numpy(), part.column(2).to_numpy()


def _merged(partial: DataFrame, combine) -> list:
    """Sums of tasks by slot, in a fixed order: ``combine`` takes columns of one slot's rows after another's, with the places where slots begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            slot = table.column("slot").to_numpy()
            order = np.lexsort((table.column("part").to_numpy(), slot))
            starts = np.flatnonzero(np.append(True, np.diff(slot[order]) != 0))
            yield pa.RecordBatch.from_arrays([pa.array(slot[order][starts]), *combine(table, order, starts, slot[order][starts])], names=["slot", "numbers", "more"])

    return sorted(partial.repartition("slot").mapInArrow(run, "slot long, numbers binary, more binary").collect())  # one row an open node


def _stack(table: pa.Table, name: str, dtype, order: np.ndarray) -> np.ndarray:
    column = table.column(name).combine_chunks()
    flat = np.frombuffer(b"".join(column.to_pylist()), dtype)
    return flat.reshape(table.num_rows, -1)[order]


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


TOTALS = np.dtype([("n", "<f8"), ("sum", "<f8"), ("low", "<f8"), ("high", "<f8")])


def _extremes(rows: DataFrame, forest: Forest, open_: np.ndarray, owner: np.ndarray, keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Totals of the open nodes, and their draws."""
    width, many = len(forest.names), len(open_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, step = _slots(forest, open_, owner)
        sums, low, high = np.zeros((many, 2)), np.full((many, width + 1), np.inf), np.full((many, width + 1), -np.inf)
        for x, y, fold in _each(batches, width, step):
            row, slot = find(x, fold)
            if len(row):
                starts = np.flatnonzero(np.append(True, np.diff(slot) != 0))
                there, values = slot[starts], np.concatenate((x, y[:, None]), 1)[row]
                sums[there, 0] += np.diff(starts, append=len(slot))
                sums[there, 1] += np.add.reduceat(y[row], starts)
                low[there] = np.minimum(low[there], np.minimum.reduceat(values, starts))
                high[there] = np.maximum(high[there], np.maximum.reduceat(values, starts))
        at = np.flatnonzero(sums[:, 0])
        part = np.full(len(at), TaskContext.get().partitionId())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(part), _binary(sums[at]), _binary(np.concatenate((low[at], high[at]), 1))], names=["slot", "part", "sums", "extremes"])

    def combine(table: pa.Table, order: np.ndarray, starts: np.ndarray, slots: np.ndarray) -> list[pa.Array]:
        sums, both = np.add.reduceat(_stack(table, "sums", "<f8", order), starts), _stack(table, "extremes", "<f8", order)
        low, high = np.minimum.reduceat(both[:, : width + 1], starts), np.maximum.reduceat(both[:, width + 1 :], starts)
        tried, cuts = draw(keys[slots], low[:, :width], high[:, :width], most)
        return [_binary(np.concatenate((sums, low[:, width:], high[:, width:]), 1)), pa.array([a.tobytes() + b.tobytes() for a, b in zip(tried, cuts)], pa.binary())]

    got = _merged(rows.mapInArrow(run, "slot long, part long, sums binary, extremes binary"), combine)
    totals, tried, cuts = np.zeros(many, TOTALS), np.full((many, min(most, width)), -1, np.int32), np.zeros((many, min(most, width)))
    for slot, numbers, more in got:
        totals[slot] = np.frombuffer(numbers, TOTALS)[0]
        tried[slot], cuts[slot] = np.frombuffer(more[: 4 * tried.shape[1]], "<i4"), np.frombuffer(more[4 * tried.shape[1] :], "<f8")
    return totals, tried, cuts


def _sides(rows: DataFrame, forest: Forest, open_: np.ndarray, owner: np.ndarray, tried: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and sums of labels to the left of each cut."""
    width, shape = len(forest.names), tried.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, step = _slots(forest, open_, owner)
        sums = np.zeros((2, *shape))
        for x, y, fold in _each(batches, width, step):
            row, slot = find(x, fold)
            if len(row):
                starts = np.flatnonzero(np.append(True, np.diff(slot) != 0))
                less = (np.take_along_axis(x[row], np.maximum(tried[slot], 0), 1) <= cuts[slot]).astype(np.float64)
                sums[0, slot[starts]] += np.add.reduceat(less, starts)
                sums[1, slot[starts]] += np.add.reduceat(less * y[row][:, None], starts)
        at = np.flatnonzero(sums[0].any(1))
        part = np.full(len(at), TaskContext.get().partitionId())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(part), _binary(sums[0, at]), _binary(sums[1, at])], names=["slot", "part", "sums", "extremes"])

    def combine(table: pa.Table, order: np.ndarray, starts: np.ndarray, slots: np.ndarray) -> list[pa.Array]:
        return [_binary(np.add.reduceat(_stack(table, c, "<f8", order), starts)) for c in ("sums", "extremes")]

    less, less_sum = np.zeros(shape), np.zeros(shape)
    for slot, numbers, more in _merged(rows.mapInArrow(run, "slot long, part long, sums binary, extremes binary"), combine):
        less[slot], less_sum[slot] = np.frombuffer(numbers, "<f8"), np.frombuffer(more, "<f8")
    return less, less_sum


def predict(df: DataFrame, forest: Forest, out: str = "pred", fold: str | None = None) -> DataFrame:
    """``df`` with ``out``, the mean of the trees of all rows, or with ``fold`` of those that have not seen the row's fold (of all rows, if they have none of it)."""
    width = len(forest.names)

    @F.arrow_udf("double")
    def mean(x: pa.Array, group: pa.Array) -> pa.Array:
        result = np.full(len(x), np.nan)
        groups = group.to_numpy(zero_copy_only=False)
        matrix = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), width)
        known = ~np.isnan(matrix).any(1)
        for g in np.unique(groups):
            roots = forest.roots(int(g))
            at = np.flatnonzero((groups == g) & known)
            step = max(1, AT_ONCE // (len(roots) + width))
            for k in range(0, len(at), step):
                some = at[k : k + step]
                result[some] = forest.value[forest.leaves(matrix[some], roots)].mean(1)
        return pa.array(result, mask=~known)

    own = F.lit(-1)
    if fold:
        number = F.col(f"`{fold}`").cast("int")
        own = F.when(number.isin([g for g in forest.groups if g >= 0]), number).otherwise(-1) if len(forest.groups) > 1 else own
    values = F.transform(_features(forest.names), lambda v: F.coalesce(v, F.lit(float("nan"))))
    return df.withColumn(out, mean(values, own))


def save(spark: SparkSession, forest: Forest, path: str) -> None:
    """Nodes as Parquet, with names and groups in each row's group of the first table."""
    nodes = zip(range(len(forest.feature)), forest.feature.tolist(), forest.cut.tolist(), forest.left.tolist(), forest.value.tolist(), forest.rows.tolist())
    spark.createDataFrame(list(nodes), "node long, feature int, cut double, left int, value double, rows long").write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame([(list(forest.names), list(forest.groups), forest.trees)], "names array<string>, groups array<int>, trees int").write.mode("overwrite").parquet(f"{path}/forest")


def load(spark: SparkSession, path: str) -> Forest:
    about = spark.read.parquet(f"{path}/forest").first()
    nodes = spark.read.parquet(f"{path}/nodes").orderBy("node").toPandas()
    return Forest(tuple(about["names"]), tuple(about["groups"]), about["trees"], *(nodes[c].to_numpy() for c in ("feature", "cut", "left", "value", "rows")))
