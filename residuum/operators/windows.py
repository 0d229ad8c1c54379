"""Positional operators: neighbours by number, flanks, ordinals, gaps, sections of a text, segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residuum.operators import keys as K


def chain_window(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def guarded(df: DataFrame, keys: Sequence[str], number: str, values: dict[str, object], step: int = 1) -> DataFrame:
    """Each value of ``values`` at number - step and + step as ``<name>_im<step>`` and ``_ip<step>``; its default where that number is missing."""
    w = chain_window(keys, [number])
    out = {}
    for name, default in values.items():
        for suffix, move, wanted in ((f"im{step}", F.lag, F.col(number) - step), (f"ip{step}", F.lead, F.col(number) + step)):
            there = move(number, step).over(w) == wanted
            out[f"{name}_{suffix}"] = F.when(there, move(name, step).over(w)).otherwise(F.lit(default))
    return df.withColumns(out)


def flanks(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, k: int, pad: str = "NONE") -> DataFrame:
    """Names of the k rows before and after, by position."""
    w = chain_window(keys, order)
    return df.withColumns({f"{name}_{s}{i}": move(name, i, pad).over(w) for i in range(1, k + 1) for s, move in (("m", F.lag), ("p", F.lead))})


def null_around(df: DataFrame, keys: Sequence[str], order: Sequence[str], bad: Column, names: Sequence[str], ends: bool = False) -> DataFrame:
    """Null ``names`` on bad rows and on their neighbours, also on the first and last rows if ``ends``."""
    w = chain_window(keys, order)
    df = df.withColumn("__bad", F.coalesce(bad, F.lit(False)))
    hit = F.col("__bad") | F.coalesce(F.lag("__bad").over(w), F.lit(ends)) | F.coalesce(F.lead("__bad").over(w), F.lit(ends))
    df = df.withColumn("__hit", hit)
    return df.withColumns({n: F.when(~F.col("__hit"), F.col(n)) for n in names}).drop("__bad", "__hit")


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], counts: Column, name: str = "ordinal") -> DataFrame:
    """How many rows up to this one count (position without gaps)."""
    w = chain_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(counts.cast("long")).over(w))


def fill_gaps(df: DataFrame, keys: Sequence[str], number: str, step: Column | None = None) -> DataFrame:
    """A row for every number between the first and the last of each key; other columns are null on new rows, rows without a number drop out."""
    span = df.groupBy(*keys).agg(F.min(number).alias("__a"), F.max(number).alias("__b"))
    every = F.sequence("__a", "__b") if step is None else F.sequence(F.col("__a"), F.col("__b"), step)
    return K.join(span.select(*keys, F.explode(every).alias(number)), df, [*keys, number], "left")


def line_numbers(df: DataFrame, keys: Sequence[str], number: str, name: str, width: int = 100_000) -> DataFrame:
    """``name``: 1, 2, ... within ``keys`` in the order of the whole numbers ``number`` (none twice). Stretches of ``width`` numbers are counted first and numbered alone, so a long key is many tasks' work."""
    rows = df.withColumn("__block", F.floor(F.col(number) / width))
    counts = rows.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(chain_window(keys, ["__block"]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = K.join(rows, counts.select(*keys, "__block", before.alias("__before")), [*keys, "__block"])
    own = F.row_number().over(chain_window([*keys, "__block"], [number]))
    return joined.withColumn("__own", own).withColumn(name, F.col("__before") + F.col("__own")).drop("__block", "__before", "__own")


def segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], breaks: Column, name: str = "segment") -> DataFrame:
    """Running number of the segment; ``breaks`` is true on a row that starts a new one."""
    return ordinal(df, keys, order, F.coalesce(breaks, F.lit(False)), name)


def sections(lines: DataFrame, keys: Sequence[str], number: str, text: str, markers: dict[str, str]) -> DataFrame:
    """``lines`` with the place of the last line that contains each marker (null if none does)."""
    last = lines.groupBy(*keys).agg(*[F.max(F.when(F.contains(F.col(text), F.lit(m)), F.col(number))).alias(name) for name, m in markers.items()])
    return K.join(lines, last, keys)


def current_section(df: DataFrame, keys: Sequence[str], order: Sequence[str], marker: Column, name: str) -> DataFrame:
    """The latest non-null marker so far: which block of a report a line belongs to."""
    w = chain_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(marker, ignorenulls=True).over(w))


def folds(key: str, k: int = 10) -> Column:
    """Fold of a row, by a hash of its key (of any type): the same on every run, even however keys are spaced."""
    return F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int")
