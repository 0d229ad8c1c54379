"""Local search against Smith-Waterman without gaps, its statistics against sampling, linear-memory alignment against the full one."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from residuum.operators import local_search, search

LETTERS = "ARND"
SCORE = np.array([[4, -3, -4, -4, -1], [-3, 5, -2, -4, -1], [-4, -2, 6, -1, -1], [-4, -4, -1, 6, -1], [-1, -1, -1, -1, -1]], float)


def at(s):
    return np.array([LETTERS.find(c) if c in LETTERS else 4 for c in s], int)


def best_segment(x, y):
    """The best score of any segment of any diagonal."""
    best = 0.0
    for d in range(-len(x) + 1, len(y)):
        run = 0.0
        for i in range(max(0, -d), min(len(x), len(y) - d)):
            run = max(0.0, run + SCORE[x[i], y[i + d]])
            best = max(best, run)
    return best


def sequences(n, size, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(LETTERS, k=size)) for _ in range(n)]


def test_scores_are_those_of_smith_waterman_without_gaps(spark):
    rng = random.Random(2)
    own = sequences(3, 60, 1)
    others = sequences(20, 80, 5)
    for k in range(12):  # planted stretches of a query, with a letter changed
        piece = list(own[k % 3][10:50])
        piece[rng.randrange(40)] = "A"
        others.append(others[k][:20] + "".join(piece) + others[k][20:])
    queries = spark.createDataFrame([*enumerate(own), (8, None), (9, "A")], "query int, sequence string")
    targets = spark.createDataFrame([*enumerate(others), (90, None), (91, "XX"), (92, "")], "target int, sequence string")
    found = local_search.search(queries, targets, SCORE.tolist(), LETTERS, least=9, drop=1e9, most_expected=1e9)
    best = {(r.query, r.target): r.s for r in found.groupBy("query", "target").agg(F.max("score").alias("s")).collect()}
    for k in range(12):
        assert best[k % 3, 20 + k] == best_segment(at(own[k % 3]), at(others[20 + k]))
    # any pair's score is at most the best, and where hits are asked for least it is the best
    assert all(s <= best_segment(at(own[q]), at(others[t])) for (q, t), s in best.items())
    top = {r.query: r.target for r in found.filter("rank = 1").collect()}
    assert {q: (t - 20) % 3 for q, t in top.items()} == {0: 0, 1: 1, 2: 2}
    for r in found.limit(50).collect():
        x, y = at(own[r.query]), at(others[r.target])
        assert r.score == SCORE[x[r.begin : r.end], y[r.begin + r.diagonal : r.end + r.diagonal]].sum()


def test_hits_neighbours_and_pairs_of_hits(spark):
    near = {}
    for r in local_search.neighbours(spark, SCORE.tolist(), LETTERS, 2, 7).collect():
        near.setdefault(r.word, set()).add(r.near)
    every = [a + b for a in LETTERS for b in LETTERS]
    assert near == {w: {v for v in every if SCORE[at(w), at(v)].sum() >= 7} for w in every}
    own, others = sequences(4, 30, 7), [*sequences(6, 40, 8), "RX" * 10]
    queries, targets = spark.createDataFrame([*enumerate(own)], "query int, sequence string"), spark.createDataFrame([*enumerate(others)], "target int, sequence string")
    table = local_search.neighbours(spark, SCORE.tolist(), LETTERS, 2, 7)
    want = {(q, t, i, j - i) for q, a in enumerate(own) for t, b in enumerate(others) for i in range(29) for j in range(len(b) - 1) if b[j : j + 2] in near.get(a[i : i + 2], ())}
    for places in (200_000, 3):  # whole, and each word in many parts
        got = local_search.hits(queries, targets, table, 2, LETTERS, places)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    second = {tuple(r) for r in local_search.second_hits(got, 2, 10).collect()}
    assert second == {(q, t, i, d) for q, t, i, d in want if any((q, t, i - n, d) in want for n in range(2, 11))}


def test_extension_stops_where_the_score_drops():
    x, y = at("AAAARRRRAAAA" + "N" * 10 + "A" * 12), at("AAAARRRRAAAA" + "A" * 22)
    assert local_search.extend(x, y, 4, 0, 3, SCORE, 5.0) == (0, 12, 52.0)
    assert local_search.extend(x, y, 4, 0, 3, SCORE, 1e9) == (0, 34, 60.0)
    assert local_search.extend(at("RRR"), at("ANRRRD"), 0, 2, 3, SCORE, 5.0) == (0, 3, 15.0)


def test_statistics_agree_with_sampling():
    shares = [0.3, 0.3, 0.2, 0.2]
    table = [[2, -1, -2, -2], [-1, 2, -1, -2], [-2, -1, 3, -2], [-2, -2, -2, 3]]
    lam, k = local_search.karlin_altschul(table, shares)
    p = np.array(shares)
    assert (p[:, None] * p[None] * np.exp(lam * np.array(table))).sum() == pytest.approx(1)
    rng = np.random.default_rng(1)
    m, best = 400, []
    for _ in range(300):
        x, y = (rng.choice(4, m, p=p) for _ in range(2))
        top = 0
        for d in range(-m + 1, m):
            s = np.array(table)[x[max(0, -d) : m - max(0, d)], y[max(0, d) : m - max(0, -d)]]
            total = np.concatenate(([0], np.cumsum(s)))
            top = max(top, (total - np.minimum.accumulate(total)).max())
        best.append(top)
    # the best score of a pair is Gumbel distributed: P(S >= s) = 1 - exp(-K m n exp(-lambda s))
    for s in np.quantile(best, [0.3, 0.6, 0.9]):
        expected = 1 - math.exp(-k * m * m * math.exp(-lam * s))
        assert np.mean(np.array(best) >= s) == pytest.approx(expected, abs=0.12)
    # the published constants of match 1, mismatch -1 at equal shares of four letters: lambda ln 3, K 1/3
    lam, k = local_search.karlin_altschul([[1 if i == j else -1 for j in range(4)] for i in range(4)], [0.25] * 4)
    assert lam == pytest.approx(math.log(3)) and k == pytest.approx(1 / 3, rel=0.01)
    with pytest.raises(ValueError):
        local_search.karlin_altschul([[1, 1], [1, 1]], [0.5, 0.5])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "target int, sequence string")
    own = spark.createDataFrame([(1, "ARND")], "query int, sequence string")
    assert local_search.search(own, none, SCORE.tolist(), LETTERS).collect() == []
    assert local_search.search(own.limit(0), none.union(own), SCORE.tolist(), LETTERS).collect() == []


def test_alignment_in_little_memory_is_the_same(monkeypatch):
    rng = random.Random(6)
    table = SCORE
    for _ in range(150):
        a, b = ("".join(rng.choices(LETTERS, k=rng.randrange(0, 40))) for _ in range(2))
        monkeypatch.setattr(search, "CELLS", 10**9)
        whole = search.align(a, b, table, LETTERS, -5.0, -0.5)
        for cells in (1, 60, 300):
            monkeypatch.setattr(search, "CELLS", cells)
            assert search.align(a, b, table, LETTERS, -5.0, -0.5) == whole


def test_a_long_alignment_keeps_to_its_memory():
    import tracemalloc

    rng = random.Random(1)
    a = "".join(rng.choices(LETTERS, k=6_000))
    b = a[:2_000] + a[2_300:4_000] + "RRNN" * 50 + a[4_000:]
    tracemalloc.start()
    x, y, _ = search.align(a, b, SCORE, LETTERS, -10.0, -0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert x.replace("-", "") == a and y.replace("-", "") == b and y.count("-") == 300 and x.count("-") == 200
    assert peak < 200e6  # three whole matrices take 860 MB


def test_copies_of_a_sequence_are_searched_with_once(spark, monkeypatch):
    own, rng = sequences(2, 40, 3), random.Random(9)
    others = [s[:20] + "".join(rng.choices(LETTERS, k=5)) + s[20:] for s in own] + sequences(1, 40, 8)
    queries = spark.createDataFrame([(k, own[k % 2]) for k in range(6)], "query int, sequence string")
    targets = spark.createDataFrame([(k, others[k % 3]) for k in range(12)] + [(20, None)], "target int, sequence string")
    met, hits = [], local_search.hits
    monkeypatch.setattr(local_search, "hits", lambda a, b, *rest: met.append((a.count(), b.count())) or hits(a, b, *rest))
    found = local_search.search(queries, targets, SCORE.tolist(), LETTERS, least=9, most_expected=1e9).collect()
    assert met == [(2, 3)]
    rows = {q: sorted(tuple(r)[1:] for r in found if r.query == q) for q in range(6)}
    assert rows[0] == rows[2] == rows[4] and rows[1] == rows[3] == rows[5]
    assert {r.target for r in found if r.query == 0} >= {0, 3, 6, 9}
    for q in range(6):
        mine = sorted((r for r in found if r.query == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(mine) + 1))
        assert mine == sorted(mine, key=lambda r: (r.expected, r.target, r.diagonal, r.begin))
