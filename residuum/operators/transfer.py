"""Transfer of labels from search hits: filters, context baselines, weighted means, best reference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residuum.functions import rules as R

# Most that a transferred secondary shift may be, by atom.
CAPS = {"H": 3.7, "HA": 3.0, "C": 10.0, "CA": 11.25, "CB": 20.0, "N": 22.0}


def sequence_hits(hits: DataFrame, exclude_self: bool = False, most_coverage: float = 0.99) -> DataFrame:
    """Two-tier filter; ``exclude_self`` drops hits that cover the query (leakage guard)."""
    kept = hits.filter(R.two_tier(F.col("evalue"), F.col("score"), F.col("lmatch"), F.col("tmatch")))
    return kept.filter(F.col("coverage") <= most_coverage) if exclude_self else kept


def structure_hits(hits: DataFrame) -> DataFrame:
    return hits.filter(R.structure_hit(F.col("tmscore"), F.col("rmsd"), F.col("coverage")))


def both_hits(sequence: DataFrame, structure: DataFrame) -> DataFrame:
    """Hits found by both searches, with the score as a share of the query's best."""
    joined = structure_hits(structure).join(sequence_hits(sequence).select("query", "target", "score"), ["query", "target"])
    return share_of_best(joined, ["query"], "score")


def hit_summary(hits: DataFrame, keys: Sequence[str] = ("query",), identity: str = "identity") -> DataFrame:
    """How many references a query has, and the largest identity among them."""
    return hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("references"), F.max(identity).alias("best_identity"))


def reconciled(aligned: DataFrame, keys: Sequence[str], own: str = "a", recognised: str = "b") -> DataFrame:
    """``keys, ordinal, letter``: the letters of one's own sequence that the other program has seen too, by their place in one's own.

    ``aligned``: both sequences with ``-`` for gaps, of one length.
    """
    letters = lambda c: F.filter(F.split(F.col(c), ""), lambda x: x != "")
    rows = aligned.select(*keys, F.posexplode(F.arrays_zip(letters(own).alias("own"), letters(recognised).alias("seen"))).alias("pos", "p"))
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*keys, "p.*", F.sum((F.col("p.own") != "-").cast("long")).over(w).alias("ordinal"))
    return rows.filter("own <> '-' AND seen <> '-'").select(*keys, "ordinal", F.col("own").alias("letter"))


def share_of_best(df: DataFrame, keys: Sequence[str], score: str, name: str | None = None) -> DataFrame:
    return df.withColumn(name or score, F.col(score) / F.max(score).over(Window.partitionBy(*keys)))


def symmetric(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """A pair table with every pair in both orders, each once."""
    rest = [c for c in pairs.columns if c not in (a, b)]
    flipped = pairs.filter(F.col(a) != F.col(b)).select(F.col(b).alias(a), F.col(a).alias(b), *rest)
    return pairs.unionByName(flipped)


def with_context(df: DataFrame, keys: Sequence[str], number: str, name: str, special: str = "PRO") -> DataFrame:
    """``context``: ``pro`` if the next number is there and has the special name, else ``ala``."""
    w = Window.partitionBy(*keys).orderBy(number)
    follows = (F.lead(number).over(w) == F.col(number) + 1) & (F.lead(name).over(w) == special)
    return df.withColumn("context", F.when(follows, "pro").otherwise("ala"))


def add_baseline(df: DataFrame, coil: DataFrame, name: str, value: str = "coil") -> DataFrame:
    """Joins the lookup ``context, resname, atom, value`` on context, name and atom; unknown ones stay null."""
    table = coil.select("context", F.col("resname").alias(name), "atom", F.col("value").alias(value))
    return df.join(F.broadcast(table), ["context", name, "atom"], "left")  # as many rows as there are names and atoms, whatever the size of df


def weighted_mean(df: DataFrame, keys: Sequence[str], value: str, weight: Column, cap: Column | float | None = None, name: str = "value") -> DataFrame:
    """Sum(w x) / sum(w) over rows with a value, clipped; null without any."""
    there = F.col(value).isNotNull()
    mean = F.sum(F.when(there, weight * F.col(value))) / F.sum(F.when(there, weight))
    out = df.groupBy(*keys).agg(mean.alias(name))
    return out if cap is None else out.withColumn(name, R.clip(F.col(name), cap))


def best_reference(df: DataFrame, keys: Sequence[str], weight: Column, ordinal: str) -> DataFrame:
    """The candidate of largest weight (missing weighs 0), the first by ``ordinal`` among equals."""
    w = Window.partitionBy(*keys).orderBy(F.coalesce(weight, F.lit(0.0)).desc(), ordinal)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def or_default(queries: DataFrame, found: DataFrame, keys: Sequence[str], zeros: Sequence[str]) -> DataFrame:
    """Every query row; without a hit the values are null and the quality columns ``zeros`` are 0."""
    joined = queries.join(found, list(keys), "left")
    return joined.withColumns({z: F.coalesce(F.col(z), F.lit(0.0)) for z in zeros})


def transferable(strict: int, same: Column, similarity: Column) -> Column:
    """Strictness 0: identical residues; 1: similar ones; 2: all."""
    return {0: same, 1: similarity > 0, 2: F.lit(True)}[strict]


def transfer_labels(alignment: DataFrame, labels: DataFrame, similarity: DataFrame, strict: int = 1, coil: DataFrame | None = None, special: str = "P") -> DataFrame:
    """Labels of targets on the positions of queries.

    ``alignment``: query, target, pos, source_res, target_res, one row an aligned column in order, ``-`` for a gap. Ordinals
    without gaps on either side number the residues; ``labels``: target, ordinal, atom, value; ``similarity``: a, b, score (symmetric).
    With ``coil`` (context, resname as letter, atom, value) the target's own random-coil value, in the context of its next residue, is taken off.
    """
    w = Window.partitionBy("query", "target").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = alignment.withColumns({f"{s}_no": F.sum((F.col(f"{s}_res") != "-").cast("long")).over(w) for s in ("source", "target")})
    if coil is not None:  # the next letter that is no gap
        later = Window.partitionBy("query", "target").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
        following = F.first(F.when(F.col("target_res") != "-", F.col("target_res")), ignorenulls=True).over(later)
        numbered = numbered.withColumn("context", F.when(following == special, "pro").otherwise("ala"))
    paired = numbered.filter("source_res <> '-' AND target_res <> '-'")
    # pairs of letters are few; without the hint the exploded rows are taken for the smaller side, since the filter below makes the join an inner one
    scored = paired.join(F.broadcast(similarity.select(F.col("a").alias("source_res"), F.col("b").alias("target_res"), "score")), ["source_res", "target_res"], "left")
    allowed = scored.filter(F.coalesce(transferable(strict, F.col("source_res") == F.col("target_res"), F.col("score")), F.lit(False)))
    # labels may be made by an explode, whose rows the planner doesn't see: never a broadcast
    found = allowed.hint("merge").join(labels.withColumnRenamed("ordinal", "target_no").hint("merge"), ["target", "target_no"])
    if coil is None:
        return found
    found = add_baseline(found, coil, "target_res")
    return found.withColumn("value", F.col("value") - F.col("coil")).drop("coil", "context")


def labels_by_alignment(alignment: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, feature_no, label_no``: which residue of the labels belongs to which of the features.

    ``alignment``: keys, pos, feature_res, label_res, ``-`` for a gap. A residue counts if its letters agree and so do both
    neighbours' (the one neighbour's at an end); numbers count letters without gaps.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    same = (F.col("feature_res") == F.col("label_res")) & (F.col("feature_res") != "-")
    rows = alignment.withColumn("__same", same).withColumns({f"{s}_no": F.sum((F.col(f"{s}_res") != "-").cast("long")).over(so_far) for s in ("feature", "label")})
    around = F.coalesce(F.lag("__same").over(w), F.lit(True)) & F.coalesce(F.lead("__same").over(w), F.lit(True))
    return rows.withColumn("__ok", F.col("__same") & around).filter("__ok").select(*keys, "feature_no", "label_no")
