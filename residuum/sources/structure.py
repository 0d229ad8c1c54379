"""Structure files: fixed-width atom records to a table and back, repair of a chain, its sequence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residuum.functions import label_text as L
from residuum.functions.lookup import RESIDUE_ALIASES

RESIDUE = ["file_id", "model", "chain", "res_num", "icode"]


def _field(first: int, last: int) -> Column:
    return F.trim(F.substring("line", first, last - first + 1))


def _number(first: int, last: int, kind: str) -> Column:
    text = _field(first, last)
    return text.try_cast(kind)


def atoms(lines: DataFrame) -> DataFrame:
    """Atom records of numbered lines. Models are numbered by their records; a file without any has model 1."""
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    model = F.last(F.when(F.col("line").startswith("MODEL "), _number(11, 14, "int")), ignorenulls=True).over(w)
    rows = lines.withColumn("model", F.coalesce(model, F.lit(1))).filter(F.substring("line", 1, 6).isin("ATOM  ", "HETATM"))
    name, stated = _field(13, 16), _field(77, 78)
    return rows.select(
        F.col("file").alias("file_id"), "model", _field(22, 22).alias("chain"), L.from_hybrid36(_field(23, 26), 4).cast("int").alias("res_num"), _field(27, 27).alias("icode"),
        F.col("line").startswith("HETATM").alias("het"), _field(18, 20).alias("resname"), name.alias("atom_name"), _field(17, 17).alias("altloc"),
        F.when(stated != "", stated).otherwise(F.regexp_extract(name, "([A-Z])", 1)).alias("element"),
        _number(31, 38, "double").alias("x"), _number(39, 46, "double").alias("y"), _number(47, 54, "double").alias("z"), _number(55, 60, "double").alias("occupancy"), _number(61, 66, "double").alias("bfactor"), "pos",
    )


def first_model(table: DataFrame) -> DataFrame:
    least = table.groupBy("file_id").agg(F.min("model").alias("model"))
    return table.join(least, ["file_id", "model"], "left_semi")


def one_chain(table: DataFrame) -> DataFrame:
    """The first model of each file; evaluating it fails where that has several chains."""
    first = first_model(table)
    several = first.groupBy("file_id").agg((F.min("chain") != F.max("chain")).alias("__several"))
    stop = F.raise_error(F.concat(F.lit("several chains in "), F.col("file_id"))).cast("boolean")
    return first.join(several, "file_id").filter(F.when(F.col("__several"), stop).otherwise(True)).drop("__several")


def one_place(table: DataFrame) -> DataFrame:
    """One place for each atom: of its alternates the one with the highest occupancy (none: lowest), of equal ones the first in the file."""
    occupancy = [F.col("occupancy").desc_nulls_last()] if "occupancy" in table.columns else []
    w = Window.partitionBy(*RESIDUE, "resname", "atom_name").orderBy(*occupancy, "pos")
    return table.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def repair(table: DataFrame) -> DataFrame:
    """Names mapped to standard ones, unknown residues dropped, of residues that share a number the first in the file kept."""
    aliases = F.create_map(*[F.lit(x) for kv in RESIDUE_ALIASES.items() for x in kv])
    named = first_model(table).withColumn("resname", F.coalesce(F.try_element_at(aliases, F.col("resname")), F.col("resname")))
    known = named.filter(F.col("resname").isin(list(L.THREE_TO_ONE)))
    first = known.groupBy("file_id", "model", "chain", "res_num").agg(F.min_by(F.struct("icode", "resname"), "pos").alias("first"))
    same = known.join(first, ["file_id", "model", "chain", "res_num"])
    return same.filter((F.col("icode") == F.col("first.icode")) & (F.col("resname") == F.col("first.resname"))).drop("first")


def sequences(table: DataFrame) -> DataFrame:
    """``file_id, model, chain, sequence, numbers`` of standard residues by number."""
    residues = table.filter(F.col("resname").isin(list(L.THREE_TO_ONE))).select("file_id", "model", "chain", "res_num", L.one_letter(F.col("resname")).alias("letter")).distinct()
    each = F.array_sort(F.collect_list(F.struct("res_num", "letter")))
    return residues.groupBy("file_id", "model", "chain").agg(each.alias("r")).select("file_id", "model", "chain", F.array_join("r.letter", "").alias("sequence"), F.col("r.res_num").alias("numbers"))


def as_lines(table: DataFrame) -> DataFrame:
    """``file_id, pos, line``: atom records in fixed width, one place an atom.

    Serials over 99,999 and residue numbers over 9,999 are in base 36 (``hybrid36``); evaluating a record with a value that its columns can't hold fails.
    """
    w = Window.partitionBy("file_id").orderBy("model", "pos")
    rows = one_place(table).withColumn("serial", F.row_number().over(w))
    name = F.when(F.length("atom_name") < 4, F.concat(F.lit(" "), F.rpad("atom_name", 3, " "))).otherwise(F.col("atom_name"))
    occupancy = F.coalesce("occupancy", F.lit(1.0)) if "occupancy" in table.columns else F.lit(1.0)
    kind = F.when(F.col("het"), "HETATM").otherwise("ATOM  ")
    line = F.format_string("%s%5s %s %3s %1s%4s%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", kind, L.hybrid36(F.col("serial"), 5), name, "resname", "chain", L.hybrid36(F.col("res_num"), 4), F.rpad("icode", 1, " "), "x", "y", "z", occupancy, F.coalesce("bfactor", F.lit(0.0)), "element")
    within = lambda c, low, high: F.coalesce((c > low) & (c < high), c.isNull())
    short = lambda c, n: F.coalesce(F.length(c) <= n, F.lit(True))
    number = F.col("res_num")
    fits = reduce(lambda a, b: a & b, [*[within(F.col(c), -999.9995, 9999.9995) for c in "xyz"], *[within(c, -99.995, 999.995) for c in (occupancy, F.col("bfactor"))], *[short(c, n) for c, n in (("atom_name", 4), ("resname", 3), ("chain", 1), ("element", 2))], within(number, -1000, L.HYBRID36_END[4]), F.col("serial") < L.HYBRID36_END[5]])
    checked = F.when(fits, line).otherwise(F.raise_error(F.concat(F.lit("a value is too wide for an atom record in "), F.col("file_id"))))
    return rows.select("file_id", F.col("serial").alias("pos"), checked.alias("line"))


def write(table: DataFrame, path: str) -> None:
    """A folder a file, its lines in order."""
    lines = as_lines(table).repartition("file_id").sortWithinPartitions("file_id", "pos")
    lines.select("file_id", "line").write.partitionBy("file_id").text(path)
