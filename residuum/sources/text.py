"""Numbered lines of many small text files, and what is read from free text in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from residuum.functions import label_text as L


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, pos, line``: a file is one row when read, so line numbers need no order between partitions."""
    files = spark.read.text(paths, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    return lines.withColumn("line", F.rtrim(F.regexp_replace("line", "\r$", "")))


def ph(lines: DataFrame, default: float = 5.0) -> DataFrame:
    """``file, ph``: the number nearest to ``pH`` in the first line that has a digit after it; the default for other files."""
    stated = lines.filter(F.col("line").rlike(r"pH.*\d")).groupBy("file").agg(F.min_by("line", "pos").alias("line"))
    found = stated.select("file", L.nearest_number(F.concat(F.col("line"), F.lit(" ")), "pH", default).alias("ph"))
    return lines.select("file").distinct().join(found, "file", "left").withColumn("ph", F.coalesce("ph", F.lit(default)))


def resolution(lines: DataFrame) -> DataFrame:
    """``file, resolution`` in angstroms, null where no line states one."""
    values = lines.select("file", "pos", L.resolution(F.col("line")).alias("v"))
    return values.groupBy("file").agg(F.min_by("v", F.when(F.col("v").isNotNull(), F.col("pos"))).alias("resolution"))


def fasta(lines: DataFrame) -> DataFrame:
    """``file, id, sequence`` of each block that a ``>`` line begins."""
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    blocks = lines.withColumn("block", F.sum(F.col("line").startswith(">").cast("int")).over(w)).filter("block > 0")
    head = F.max(F.when(F.col("line").startswith(">"), F.regexp_extract("line", r"^>\s*(\S+)", 1)))
    body = F.array_sort(F.collect_list(F.when(~F.col("line").startswith(">"), F.struct("pos", F.trim("line").alias("line")))))
    return blocks.groupBy("file", "block").agg(head.alias("id"), F.array_join(F.transform(body, lambda x: x["line"]), "").alias("sequence")).drop("block")


def batch_list(lines: DataFrame, default_ph: float = 5.0) -> DataFrame:
    """``path, ph`` of a list with one file and, if stated, its pH a line."""
    parts = F.split(F.trim("line"), r"\s+")
    number = F.get(parts, F.lit(1))
    stated = number.try_cast("double")
    return lines.filter(F.trim("line") != "").select(F.get(parts, F.lit(0)).alias("path"), F.coalesce(stated, F.lit(default_ph)).alias("ph"))


def as_fasta(sequences: DataFrame, id_col: str, sequence_col: str, width: int = 60) -> DataFrame:
    """``line`` of each sequence's block: write with ``.write.text``."""
    body = F.rtrim(F.regexp_replace(F.col(sequence_col), f"(.{{1,{width}}})", "$1\n"))
    return sequences.select(F.concat(F.lit(">"), F.col(id_col), F.lit("\n"), body).alias("line"))
