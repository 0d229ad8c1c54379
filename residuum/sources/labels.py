"""Label tables: shifts, order parameters and pH in three sections of a text file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.functions import rules as R
from residuum.operators import curate
from residuum.operators import windows as W

ATOMS = ("H", "HA", "C", "CA", "CB", "N")


def _marked(lines: DataFrame) -> DataFrame:
    """Lines with the place of the last line that names each section, and their fields."""
    marked = W.sections(lines, ["file"], "pos", "line", {"format_at": "FORMAT", "s2_at": "S2", "ph_at": "pH"})
    return marked.withColumn("f", F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != ""))


def shifts(lines: DataFrame) -> DataFrame:
    """``file, resid, res1, atom, shift, pos``: a line more than the format line's next, up to the S2 line; the last of a repeated atom."""
    rows = _marked(lines).filter("pos >= format_at + 2 AND pos < s2_at AND size(f) = 4")
    number = F.get("f", F.lit(3)).try_cast("double")
    parsed = rows.select("file", F.get("f", F.lit(0)).try_cast("int").alias("resid"), F.get("f", F.lit(1)).alias("res1"), F.get("f", F.lit(2)).alias("atom"), number.alias("shift"), "pos")
    return parsed.groupBy("file", "resid", "atom").agg(F.max_by("res1", "pos").alias("res1"), F.max_by("shift", "pos").alias("shift"), F.max("pos").alias("pos"))


def order_parameters(lines: DataFrame, shift_rows: DataFrame) -> DataFrame:
    """``file, resid, s2``: null where the letter differs from that of the shifts."""
    rows = _marked(lines).filter("pos > s2_at AND pos < ph_at AND size(f) = 3")
    s2 = rows.select("file", F.get("f", F.lit(0)).try_cast("int").alias("resid"), F.get("f", F.lit(1)).try_cast("double").alias("s2"), F.get("f", F.lit(2)).alias("letter"))
    own = shift_rows.groupBy("file", "resid").agg(F.min_by("res1", "pos").alias("res1"))
    return s2.join(own, ["file", "resid"]).select("file", "resid", F.when(F.col("letter") == F.col("res1"), F.col("s2")).alias("s2"))


def stated_ph(lines: DataFrame) -> DataFrame:
    """``file, ph``: the value below the pH line."""
    value = F.trim("line")
    return _marked(lines).filter("pos = ph_at + 1").select("file", value.try_cast("double").alias("ph"))


def wide(shift_rows: DataFrame) -> DataFrame:
    """One row a residue with the six atoms: HN stands for H, HA2 and HA3 for HA (their mean, or the one that is there)."""
    table = curate.pivot_labels(shift_rows, ["file", "resid"], "atom", "shift", (*ATOMS, "HN", "HA2", "HA3"))
    table = table.withColumn("HA", R.merge_alternates(F.col("HA2"), F.col("HA3"), F.col("HA"))).withColumn("H", F.coalesce("HN", "H"))
    return table.select("file", "resid", *ATOMS)
