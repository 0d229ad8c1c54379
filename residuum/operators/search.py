"""Sequence search and alignment: seeds as an equality join, identities on arrays, affine-gap alignment in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeds(df: DataFrame, id_col: str, units: Column, k: int, joiner: str = "") -> DataFrame:
    """Distinct seeds of k consecutive units (an array: letters of a sequence, or words) of each row."""
    each = F.transform(F.array(units), lambda u: F.when(F.size(u) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(u) - k + 1), lambda i: F.array_join(F.slice(u, i, k), joiner)))))[0]
    return df.select(F.col(id_col), F.explode(each).alias("seed"))


def letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


#: Most distinct seeds of the queries that are broadcast to the targets' scan (8 bytes each); beyond it the two sides are shuffled.
MOST_BROADCAST = 2_000_000


def seeds_among(df: DataFrame, id_col: str, units: Column, k: int, wanted: DataFrame, joiner: str = "") -> DataFrame:
    """As ``seeds``, but only those of ``wanted`` (column seed): windows are told apart by a hash first, and only those whose hash is wanted are written out.

    Hashes are few where the wanted seeds are, so the scan sends on next to nothing of texts that share none.
    """
    w = F.col("__units")
    parts = [F.slice(w, F.lit(j + 1), F.size(w)) for j in range(k)]
    windows = F.slice(F.arrays_zip(*[p.alias(f"u{j}") for j, p in enumerate(parts)]), F.lit(1), F.greatest(F.lit(0), F.size(w) - k + 1))
    each = df.select(F.col(id_col), units.alias("__units")).select(id_col, F.explode(windows).alias("__w"))
    each = each.withColumn("__h", F.xxhash64(*[F.col(f"__w.u{j}") for j in range(k)]))
    few = wanted.select("seed").distinct()
    split = F.split("seed", joiner) if joiner else letters(F.col("seed"))
    hashes = few.select(F.xxhash64(*[F.get(split, F.lit(j)) for j in range(k)]).alias("__h")).distinct()
    if hashes.count() <= MOST_BROADCAST:
        hashes = F.broadcast(hashes)
    kept = each.join(hashes, "__h", "left_semi")
    return kept.select(id_col, F.concat_ws(joiner, *[F.col(f"__w.u{j}") for j in range(k)]).alias("seed")).distinct()


def seed_hits(queries: DataFrame, targets: DataFrame, query_id: str, target_id: str, least: int = 1) -> DataFrame:
    """Shared seeds of each query and target, and the rank of the target (ties by id). Both sides: id, seed."""
    shared = queries.join(targets, "seed").groupBy(query_id, target_id).agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least)
    w = Window.partitionBy(query_id).orderBy(F.desc("shared"), target_id)
    return shared.withColumn("rank", F.row_number().over(w))


def identity(a: Column, b: Column) -> Column:
    """Share of identical columns of two aligned texts, columns with a gap in both left out."""
    pairs = F.filter(F.zip_with(letters(a), letters(b), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: ~((p["x"] == "-") & (p["y"] == "-")))
    return F.size(F.filter(pairs, lambda p: p["x"] == p["y"])) / F.size(pairs)


#: Cells of the matrices that an alignment holds at a time; longer ones are cut in halves and worked out again on the way back.
CELLS = 2_000_000


def align(a: str, b: str, score: np.ndarray, letters: str, gap_open: float = -10.0, gap_extend: float = -0.5) -> tuple[str, str, float]:
    """Global alignment with affine gaps (Gotoh); of equal ones a match is preferred to a gap in b, that to a gap in a.

    ``score``: similarity of ``letters`` by ``letters``; its last row and column are for any other letter. Rows are halved until a part has few
    enough cells: the first half is run through for its last row alone, the second is traced back, then the first. So memory is in proportion to one
    sequence (times the logarithm of the other), and the alignment is the one that whole matrices give.
    """
    other = len(letters)
    at = {c: k for k, c in enumerate(letters)}
    x, y = [at.get(c, other) for c in a], [at.get(c, other) for c in b]
    n, m = len(x), len(y)
    steps = np.arange(m + 1) * gap_extend
    none = np.full(m + 1, -1e18)
    Row = tuple[np.ndarray, np.ndarray, np.ndarray]

    def first_row() -> Row:
        row = none.copy()
        row[0] = 0
        return closed(row, none.copy())

    def closed(row: np.ndarray, down: np.ndarray) -> Row:
        """A gap in a is a running maximum along the row."""
        right = none.copy()
        right[1:] = (np.maximum.accumulate(row - steps) + steps + gap_open - gap_extend)[:-1] + gap_extend
        return np.maximum(row, right), down, right

    def following(i: int, before: Row) -> Row:
        down = np.maximum(before[0] + gap_open, before[1] + gap_extend)
        row = down.copy()
        row[1:] = np.maximum(before[0][:-1] + score[x[i - 1], y], down[1:])
        return closed(row, down)

    out_a, out_b, final = [], [], 0.0

    def back(low: int, high: int, start: Row, j: int, state: str) -> tuple[int, str]:
        """Trace from row ``high`` to row ``low``, whose values are ``start``; where in it and in what state the path arrives."""
        nonlocal final
        if (high - low) * (m + 1) > CELLS and high - low > 1:
            middle, row = (low + high) // 2, start
            for i in range(low + 1, middle + 1):
                row = following(i, row)
            j, state = back(middle, high, row, j, state)
            del row
            return back(low, middle, start, j, state)
        rows = [start]
        for i in range(low + 1, high + 1):
            rows.append(following(i, rows[-1]))
        i = high
        if high == n and not out_a:
            final = float(rows[-1][0][m])
        while i > low or (low == 0 and j):
            best, down, right = rows[i - low]
            if state == "best":
                if i and j and best[j] == rows[i - low - 1][0][j - 1] + score[x[i - 1], y[j - 1]]:
                    i, j = i - 1, j - 1
                    out_a.append(a[i])
                    out_b.append(b[j])
                    continue
                state = "down" if best[j] == down[j] else "right"
            if state == "down":
                state = "best" if down[j] == rows[i - low - 1][0][j] + gap_open else "down"
                i -= 1
                out_a.append(a[i])
                out_b.append("-")
            else:
                state = "best" if right[j] == best[j - 1] + gap_open else "right"
                j -= 1
                out_a.append("-")
                out_b.append(b[j])
        return j, state

    back(0, n, first_row(), m, "best")
    return "".join(reversed(out_a)), "".join(reversed(out_b)), final


def align_pairs(pairs: DataFrame, a: str, b: str, score: list[list[float]], letters: str, gap_open: float = -10.0, gap_extend: float = -0.5) -> DataFrame:
    """``pairs`` with ``aligned`` (a, b, score); pairs are spread over tasks as they come, one alignment is a row's work."""
    table = np.array(score, float)

    @F.pandas_udf("a string, b string, score double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for left, right in batches:
            yield pd.DataFrame([align(p or "", q or "", table, letters, gap_open, gap_extend) for p, q in zip(left, right)], columns=["a", "b", "score"])

    return pairs.withColumn("aligned", run(F.col(a), F.col(b)))


def sequence_search(queries: DataFrame, targets: DataFrame, k: int, score: list[list[float]], alphabet: str, least: int = 2, gap_open: float = -10.0, gap_extend: float = -0.5) -> DataFrame:
    """``query, target, shared, aligned, rank``: targets with at least ``least`` seeds of a query, aligned to it and ranked by the alignment's score (ties by target).

    ``queries``: query, sequence; ``targets``: target, sequence; both with distinct ids. Only pairs that share seeds are aligned, and sequences are joined to these pairs alone.
    """
    own = seeds(queries, "query", letters(F.col("sequence")), k)
    hits = seed_hits(own, seeds_among(targets, "target", letters(F.col("sequence")), k, own), "query", "target", least).drop("rank")
    pairs = hits.join(queries.select("query", F.col("sequence").alias("__a")), "query").join(targets.select("target", F.col("sequence").alias("__b")), "target")
    found = align_pairs(pairs, "__a", "__b", score, alphabet, gap_open, gap_extend).select("query", "target", "shared", "aligned")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("aligned.score"), "target")))


def superpose(p: np.ndarray, q: np.ndarray) -> float:
    """Root-mean-square distance of two point sets after the best rotation (Kabsch)."""
    p, q = p - p.mean(0), q - q.mean(0)
    u, s, vt = np.linalg.svd(p.T @ q)
    s[-1] *= np.sign(np.linalg.det(u @ vt))
    return float(np.sqrt(max(0.0, ((p * p).sum() + (q * q).sum() - 2 * s.sum()) / len(p))))


def _turn(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotation and centres of the superposition that minimises the distance of two point sets."""
    p, q = a.mean(0), b.mean(0)
    u, s, vt = np.linalg.svd((a - p).T @ (b - q))
    return u @ np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt))]) @ vt, p, q


def tm_score(p: np.ndarray, q: np.ndarray, length: int, rounds: int = 20) -> float:
    """TM-score of aligned points, ``length`` normalises: the best over superpositions that start from all points and from fragments of half and a
    quarter of them and are repeated on the pairs that are near each other, until these settle."""
    d0 = max(0.5, 1.24 * max(length - 15, 1) ** (1 / 3) - 1.8)
    reach, n, best = max(4.5, min(8.0, d0)), len(p), 0.0
    parts = {(0, n)} | {(k, k + size) for size in (n // 2, n // 4) if size >= 4 for k in range(0, n - size + 1, max(1, size // 2))}
    for first, last in sorted(parts):
        chosen = np.arange(first, last)
        for _ in range(rounds):
            turn, a, b = _turn(p[chosen], q[chosen])
            d2 = (((p - a) @ turn - (q - b)) ** 2).sum(1)
            best = max(best, float((1 / (1 + d2 / d0**2)).sum() / length))
            near = np.flatnonzero(d2 <= reach**2)
            if len(near) < 3 or np.array_equal(near, chosen):
                break
            chosen = near
    return best


def structure_scores(pairs: DataFrame) -> DataFrame:
    """``query, target, rmsd, tmscore`` of pairs with columns query, target, p, q: aligned coordinates as array<array<double>>."""

    @F.pandas_udf("rmsd double, tmscore double")
    def run(p: pd.Series, q: pd.Series) -> pd.DataFrame:
        rows = [(superpose(x, y), tm_score(x, y, len(x))) for x, y in ((np.array(list(map(list, u))), np.array(list(map(list, v)))) for u, v in zip(p, q))]
        return pd.DataFrame(rows, columns=["rmsd", "tmscore"])

    return pairs.withColumn("__s", run("p", "q")).select("query", "target", "__s.rmsd", "__s.tmscore")
