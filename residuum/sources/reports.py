"""Reports of search programs: sequence hits with aligned lines, and matrices of pairwise scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from residuum.functions import rules as R
from residuum.operators import search
from residuum.operators import windows as W


def sequence_hits(lines: DataFrame, lengths: DataFrame) -> DataFrame:
    """``file, target, score, evalue, lmatch, tmatch, source_seq, target_seq, coverage``.

    ``lines``: file, pos, line of reports; ``lengths``: file, length of the query. Which block a line belongs to is carried
    forward; of a target's alignments the first counts, and of its lines those that continue where the last one ended.
    """
    order = ["pos"]
    listed = F.contains(F.col("line"), F.lit("Sequences producing significant alignments:"))
    marker = F.when(listed, "#list").when(F.col("line").startswith(">"), F.regexp_extract("line", r"^>\s*(\S+)", 1))
    blocks = W.current_section(lines, ["file"], order, marker, "block").filter("block IS NOT NULL").withColumn("listed", listed)
    fields = F.split(F.trim("line"), r"\s+")
    table = blocks.filter((F.col("block") == "#list") & ~F.col("listed") & (F.trim("line") != "")).select("file", F.get(fields, F.lit(0)).alias("target"), F.try_element_at(fields, F.lit(-2)).try_cast("double").alias("score"), F.try_element_at(fields, F.lit(-1)).try_cast("double").alias("evalue"))
    inside = blocks.filter("block <> '#list'").withColumnRenamed("block", "target")
    inside = W.ordinal(inside, ["file", "target"], order, F.contains(F.col("line"), F.lit("Identities =")), "hsp").filter("hsp = 1")
    share = F.regexp_extract("line", r"Identities = *(\d+)/(\d+)", 1), F.regexp_extract("line", r"Identities = *(\d+)/(\d+)", 2)
    matched = inside.filter(share[0] != "").select("file", "target", share[0].try_cast("int").alias("lmatch"), share[1].try_cast("int").alias("tmatch"))
    parts = inside.filter(F.col("line").rlike(r"^(Query|Sbjct):?\s+\d+\s+\S+\s+\d+")).withColumn("side", F.substring("line", 1, 5)).withColumn("from", F.get(fields, F.lit(1)).try_cast("int")).withColumn("to", F.get(fields, F.lit(3)).try_cast("int")).withColumn("letters", F.get(fields, F.lit(2)))
    w = Window.partitionBy("file", "target", "side").orderBy("pos")
    gap = F.coalesce(F.col("from") != F.lag("to").over(w) + 1, F.lit(False))
    parts = W.segments(parts.withColumn("gap", gap), ["file", "target", "side"], order, F.col("gap")).filter("segment = 0")
    joined = parts.groupBy("file", "target", "side").agg(F.array_sort(F.collect_list(F.struct("pos", "letters"))).alias("p")).withColumn("seq", F.array_join("p.letters", ""))
    seqs = joined.groupBy("file", "target").pivot("side", ["Query", "Sbjct"]).agg(F.first("seq")).withColumnsRenamed({"Query": "source_seq", "Sbjct": "target_seq"})
    hits = table.join(matched, ["file", "target"]).join(seqs, ["file", "target"], "left").join(lengths, "file")
    return hits.withColumn("coverage", R.coverage(F.col("lmatch"), F.col("tmatch"), F.col("length"))).drop("length")


def score_row(lines: DataFrame, query: str, name: str) -> DataFrame:
    """``file, target, <name>`` from a matrix: the title line names the columns, the query's line holds its scores."""
    fields = F.split(F.trim("line"), r"\s+")
    title = lines.filter("pos = 0").select("file", F.transform(fields, lambda x: F.regexp_replace(x, r"\.pdb$", "")).alias("title"))
    own = lines.filter((F.col("pos") > 0) & (F.get(fields, F.lit(0)) == query)).select("file", F.slice(fields, 2, F.size(fields) - 1).alias("scores"))
    pairs = title.join(own, "file").select("file", F.explode(F.arrays_zip("title", "scores")).alias("p"))
    return pairs.select("file", F.col("p.title").alias("target"), F.col("p.scores").try_cast("double").alias(name)).filter(F.col("target") != query.removesuffix(".pdb"))


def structure_hits(rmsd: DataFrame, tm: DataFrame, aligned: DataFrame, query: str) -> DataFrame:
    """``file, target, rmsd, tmscore, coverage``; ``aligned``: file, id, sequence of the multiple alignment."""
    own = aligned.filter(F.col("id") == query).select("file", F.col("sequence").alias("source_seq"))
    others = aligned.filter(F.col("id") != query).select("file", F.regexp_replace("id", r"\.pdb$", "").alias("target"), F.col("sequence").alias("target_seq"))
    pairs = others.join(own, "file").withColumn("coverage", search.identity(F.col("source_seq"), F.col("target_seq")))
    return score_row(rmsd, query, "rmsd").join(score_row(tm, query, "tmscore"), ["file", "target"]).join(pairs.drop("source_seq", "target_seq"), ["file", "target"])
