"""Randomised trees against a recursive fit of the same draws, folds against separate fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from residuum.operators import trees


def grown(x, y, key, most, leaf, split, depth):
    """A tree as nested tuples, by recursion over rows."""
    n, value = len(y), y.mean() if len(y) else 0.0
    if depth == 0 or n < max(split, 2 * leaf) or y.min() == y.max():
        return value
    tried, cuts = trees.draw(np.array([key], np.uint64), x.min(0)[None], x.max(0)[None], most)
    best = None
    for f, c in zip(tried[0], cuts[0]):
        left = x[:, f] <= c
        if f >= 0 and left.sum() >= leaf and (~left).sum() >= leaf:
            error = ((y[left] - y[left].mean()) ** 2).sum() + ((y[~left] - y[~left].mean()) ** 2).sum()
            if best is None or error < best[0] - 1e-9:
                best = error, f, c, left
    if best is None:
        return value
    _, f, c, left = best
    keys = trees.mix(np.array([key], np.uint64) * np.uint64(2) + np.array([0, 1], np.uint64))
    return f, c, grown(x[left], y[left], keys[0], most, leaf, split, depth - 1), grown(x[~left], y[~left], keys[1], most, leaf, split, depth - 1)


def told(forest, node):
    if forest.feature[node] < 0:
        return forest.value[node]
    return forest.feature[node], forest.cut[node], told(forest, forest.left[node]), told(forest, forest.left[node] + 1)


def same(a, b):
    if not isinstance(a, tuple) or not isinstance(b, tuple):
        return not isinstance(a, tuple) and not isinstance(b, tuple) and a == pytest.approx(b)
    return a[0] == b[0] and a[1] == pytest.approx(b[1]) and same(a[2], b[2]) and same(a[3], b[3])


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=300), rng.integers(0, 3, 300), np.full(300, 2.0), rng.uniform(size=300), rng.normal(size=300) * (rng.uniform(size=300) < 0.1)])
    y = np.round(3 * x[:, 0] + x[:, 1] ** 2 + rng.normal(size=300), 2)
    rows = [(k, k % 4 if k % 50 else None, *map(float, r), float(v)) for k, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "k int, fold int, a double, b double, c double, d double, e double, y double").repartition(5)


NAMES = ["a", "b", "c", "d", "e"]


def arrays(table, where="true"):
    rows = table.filter(where).orderBy("k").collect()
    return np.array([[r[n] for n in NAMES] for r in rows]), np.array([r.y for r in rows])


def roots(count, seed):
    return trees.mix(np.arange(count, dtype=np.uint64) ^ trees.mix(np.array([seed], np.uint64)))


def test_trees_are_those_of_a_recursive_fit(spark, table):
    x, y = arrays(table)
    for leaf, split, subset, depth in ((3, 15, 0.5, 60), (1, 2, 0.3, 4), (7, 12, 1.0, 60)):
        forest = trees.fit(table, NAMES, "y", trees=4, subset=subset, leaf=leaf, split=split, depth=depth, seed=9)
        want = [grown(x, y, k, max(1, int(subset * 5)), leaf, split, depth) for k in roots(4, 9)]
        assert all(same(told(forest, t), w) for t, w in zip(range(4), want))
        leaves = forest.feature < 0
        assert forest.rows[leaves].min() >= leaf and forest.rows[leaves].sum() == 4 * 300


def test_folds_together_equal_separate_fits(spark, table, monkeypatch):
    together = trees.fit(table, NAMES, "y", trees=3, subset=0.5, seed=2, fold="fold", folds=4)
    assert together.groups == (0, 1, 2, 3, -1)
    for g in together.groups:
        alone = trees.fit(table.filter(F.coalesce(F.col("fold") != g, F.lit(True))), NAMES, "y", trees=3, subset=0.5, seed=2)
        assert all(same(told(together, a), told(alone, b)) for a, b in zip(together.roots(g), alone.roots(-1)))
    monkeypatch.setattr(trees, "SLICE_BYTES", 2_000)  # open nodes in many slices
    again = trees.fit(table.coalesce(1), NAMES, "y", trees=3, subset=0.5, seed=2, fold="fold", folds=4)
    assert all(same(told(together, r), told(again, r)) for r in range(15))


def test_predictions_are_means_of_leaves_of_trees_that_have_not_seen_the_row(spark, table):
    forest = trees.fit(table, NAMES, "y", trees=5, subset=0.5, fold="fold", folds=4)
    x, _ = arrays(table)
    got = {r.k: r.p for r in trees.predict(table, forest, "p", "fold").collect()}

    def walk(node, row):
        while forest.feature[node] >= 0:
            node = forest.left[node] + (row[forest.feature[node]] > forest.cut[node])
        return forest.value[node]

    for k in range(300):
        group = k % 4 if k % 50 else -1
        assert got[k] == pytest.approx(np.mean([walk(r, x[k]) for r in forest.roots(group)]))
    plain = {r.k: r.p for r in trees.predict(table, forest, "p").collect()}
    assert plain[1] == pytest.approx(np.mean([walk(r, x[1]) for r in forest.roots(-1)]))


def test_odd_tables(spark, table):
    odd = table.withColumn("a", F.when(F.col("k") % 10 > 0, F.col("a"))).withColumn("y", F.when(F.col("k") % 7 > 0, F.col("y")).otherwise(F.when(F.col("k") % 2 == 0, float("nan"))))
    forest = trees.fit(odd, NAMES, "y", trees=2, subset=0.5)
    assert forest.rows[0] == sum(k % 10 > 0 and k % 7 > 0 for k in range(300))
    assert {r.k for r in trees.predict(odd, forest, "p").filter("p IS NULL").collect()} == set(range(0, 300, 10))
    flat = trees.fit(table.withColumn("y", F.lit(2.5)), NAMES, "y", trees=2)
    assert flat.value.tolist() == [2.5, 2.5]
    empty = trees.fit(table.limit(0), NAMES, "y", trees=2, fold="fold", folds=2)
    assert trees.predict(table.limit(3), empty, "p", "fold").select(F.sum("p")).first()[0] == 0
