"""Mixing sources to target weights by weighted fair queueing.

Every source is a flow. Its documents are put in a random but fixed order (an MD5 of the id) and offered
``max_epochs`` times. A copy's virtual finish time is the number of its source's tokens up to and including it,
divided by the source's target. All copies of all sources are sorted by finish time and the order is cut where
the total budget is used up, which serves each source in proportion to its target.

Rows of the same id, source and size are interchangeable, so they are counted and queued as runs: those of a run that finish by time 1 are one
entry, since all that finish by then fit into the budget (targets add up to no more); of the rest only as many as the budget's remainder could hold are
queued, one by one. So the cut falls between two rows, never between two runs, and a row with any number of copies costs a few entries.

Defined cases. Null text: size 0. Null source: a source of its own, after all others. Null ids: shuffled as the
empty string. Repeated rows (same id, source and size): numbered; the first ``part`` of them are taken once more than the others. Empty table: empty result. A source without words: target 0,
nothing taken. Extra columns pass through unchanged whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residuum.llm.common import n_words, running_total, stash

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Copies from which a row's kind is sent to the tasks, if there are at most ``MOST_HOT`` such kinds.
HOT_COPIES, MOST_HOT = 10_000, 50_000
SEED = "mix-0"


def targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size`` -> also ``source_rank, target``; one row a source, so windows over the whole table are small.

    Shares follow the weights, but no target exceeds ``max_epochs`` times its source. Sorted by how soon they reach that
    cap, the capped sources are a prefix, and the level of the others is (all - caps before) / weights from here on.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    by_cap = Window.orderBy("__ratio", "source_rank")
    ranked = totals.withColumn("source_rank", F.row_number().over(by_name))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_rank") - 1) % len(weights) + 1)
    capped = (
        ranked.withColumn("__w", weight.cast("long"))
        .withColumn("__cap", F.col("source_size") * max_epochs)
        .withColumn("__ratio", F.col("__cap") / F.col("__w"))
        .withColumn("__all", F.sum("source_size").over(every))
        .withColumn("__caps", F.coalesce(F.sum("__cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("__rest", F.sum("__w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("__level", (F.col("__all") - F.col("__caps")) / F.col("__rest"))
        .withColumn("__level", F.max(F.when(F.col("__level") <= F.col("__ratio"), F.col("__level"))).over(every))
    )
    target = F.least(F.col("__cap").cast("double"), F.coalesce(F.col("__level") * F.col("__w"), F.col("__cap").cast("double")))
    return capped.select("source", "source_size", "source_rank", target.alias("target"), F.col("__all").alias("budget"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """``id, source, size, repeats, source_size, target, epochs, part``: of each distinct (id, source, size) ``part`` rows are taken epochs + 1 times, the others epochs times.

    Only ids, sources and sizes are shuffled; the text is read once.
    """
    size = n_words(F.col("text")) if size is None else size
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"))
    rows = stash(rows.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("repeats")), "mix-sizes").withColumn("__words", F.col("size") * F.col("repeats"))
    levels = stash(targets(rows.groupBy("source").agg(F.sum("__words").alias("source_size")), weights, max_epochs), "mix-targets")
    rows = rows.join(levels, rows["source"].eqNullSafe(levels["source"])).drop(levels["source"])
    rows = rows.withColumn("__h", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    order = ["source_rank", "__h", "id", "size"]
    served = running_total(rows, order, "__words", "__served", "mix-served")
    before = levels.select("source_rank", F.coalesce(F.sum("source_size").over(Window.orderBy("source_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__earlier"))
    served = served.join(before, "source_rank").filter("target > 0")
    runs = served.withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    # tokens of the source before the run's first row, and rows of the run that finish by time 1
    runs = runs.withColumn("__begin", F.col("__epoch") * F.col("source_size") + F.col("__served") - F.col("__earlier") - F.col("__words"))
    fitting = F.when(F.col("size") > 0, F.floor((F.col("target") - F.col("__begin")) / F.col("size"))).otherwise(F.when(F.col("__begin") <= F.col("target"), F.col("repeats")).otherwise(0))
    runs = stash(runs.withColumn("__sooner", F.least(F.col("repeats"), F.greatest(F.lit(0), fitting)).cast("long")), "mix-runs")
    rest = levels.agg(F.max("budget").alias("b")).crossJoin(runs.agg(F.coalesce(F.sum(F.col("__sooner") * F.col("size")), F.lit(0)).alias("t"))).select((F.col("b") - F.col("t")).alias("rest")).first()["rest"]  # one number
    rest = int(rest or 0)
    finish = lambda k: (F.col("__begin") + F.col("size") * k) / F.col("target")
    sooner = runs.filter("__sooner > 0").select("*", F.lit(0).cast("long").alias("__k"), finish(F.col("__sooner")).alias("__finish"), F.col("__sooner").alias("__rows"))
    # later rows that the rest of the budget reaches, one by one; those without words together
    reach = F.floor((rest + F.greatest(F.lit(0.0), F.col("target") - F.col("__begin"))) / F.col("size")) + 1
    late = runs.filter((F.col("__sooner") < F.col("repeats")) & (F.col("__begin") <= F.col("target") + rest))
    last = F.when(F.col("size") > 0, F.least(F.col("repeats"), reach)).otherwise(F.col("__sooner") + 1)
    later = late.withColumn("__k", F.explode(F.when(last > F.col("__sooner"), F.sequence(F.col("__sooner") + 1, last.cast("long")))))
    later = later.select("*", finish(F.col("__k")).alias("__finish"), F.when(F.col("size") > 0, 1).otherwise(F.col("repeats") - F.col("__sooner")).cast("long").alias("__rows"))
    queue = sooner.unionByName(later).withColumn("__entry", F.col("size") * F.col("__rows"))
    queue = running_total(queue, ["__finish", *order, "__epoch", "__k"], "__entry", "__total", "mix-queue")
    by_epoch = queue.filter(F.col("__total") <= F.col("budget")).groupBy("id", "source", "size", "repeats", "__epoch").agg(F.sum("__rows").alias("__rows"))
    # rows are numbered alike in every epoch, and at most one epoch of a run is taken in part
    whole = F.col("__rows") == F.col("repeats")
    taken = by_epoch.groupBy("id", "source", "size").agg(F.count_if(whole).cast("int").alias("epochs"), F.coalesce(F.max(F.when(~whole, F.col("__rows"))), F.lit(0)).alias("part"))
    kept = rows.select("id", "source", "size", "repeats", "source_size", "target")
    same = [kept[c].eqNullSafe(taken[c]) for c in ("id", "source", "size")]
    return kept.join(taken, same, "left").select(*[kept[c] for c in kept.columns], F.coalesce(taken["epochs"], F.lit(0)).alias("epochs"), F.coalesce(taken["part"], F.lit(0)).cast("long").alias("part"))


def dealt(plan: DataFrame, chunk: int = 4096) -> DataFrame:
    """``plan`` row by row: each of its ``repeats`` rows with ``times``, how often it is taken. Rows with very many copies are spread before they are written out."""
    numbers = lambda a, b: F.explode(F.sequence(a, b))
    few = plan.filter(F.col("repeats") <= chunk).withColumn("__k", numbers(F.lit(1).cast("long"), F.col("repeats")))
    many = plan.filter(F.col("repeats") > chunk).withColumn("__c", numbers(F.lit(0).cast("long"), F.floor((F.col("repeats") - 1) / chunk))).repartition("id", "source", "size", "__c")
    many = many.withColumn("__k", numbers(F.col("__c") * chunk + 1, F.least(F.col("repeats"), (F.col("__c") + 1) * chunk))).drop("__c")
    return few.unionByName(many).withColumn("times", F.col("epochs") + F.when(F.col("__k") <= F.col("part"), 1).otherwise(0)).drop("__k")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it (0 to ``max_epochs`` times), all columns unchanged."""
    size = n_words(F.col("text")) if size is None else size
    plan = plan_mix(docs, id_col, source_col, size, **options).filter("epochs > 0 OR part > 0")
    plan = stash(plan.select(*[F.col(c).alias(f"__mix_{c}") for c in ("id", "source", "size", "repeats", "epochs", "part")]), "mix-plan")
    sized = docs.withColumn("__mix_own", size)

    def met(rows: DataFrame, wanted: DataFrame, how: str = "inner") -> DataFrame:
        return rows.join(wanted, rows[id_col].eqNullSafe(wanted["__mix_id"]) & rows[source_col].eqNullSafe(wanted["__mix_source"]) & (rows["__mix_own"] == wanted["__mix_size"]), how)

    # kinds of rows with very many copies, and those taken in part (one a source at most), go to the tasks instead of being shuffled
    apart = (F.col("__mix_repeats") > HOT_COPIES) | (F.col("__mix_part") > 0)
    few = plan.filter(apart)
    if few.limit(MOST_HOT + 1).count() <= MOST_HOT:
        few = F.broadcast(few)
        found = met(sized, few).unionByName(met(met(sized, few, "left_anti"), plan.filter(~apart)))
    else:
        found = met(sized, plan)
    found = found.withColumn("__mix_times", F.col("__mix_epochs"))
    if not plan.filter("__mix_part > 0").isEmpty():
        found = found.filter("__mix_part = 0").unionByName(_in_part(found.filter("__mix_part > 0"), plan.filter("__mix_part > 0"), docs))
    copies = found.filter("__mix_times > 0").withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_times"))))
    return copies.select(*[copies[c] for c in docs.columns])


def _in_part(found: DataFrame, kinds: DataFrame, docs: DataFrame) -> DataFrame:
    """``found``, rows of ``kinds`` that are taken in part: numbered by a hash of their columns, the first ``part`` of each kind once more than the others."""
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = found.withColumns({"__mix_hash": F.xxhash64(*hashed), "__mix_row": F.monotonically_increasing_id(), "__mix_one": F.lit(1).cast("long")})
    kind = ["__mix_id", "__mix_source", "__mix_size"]
    rows = running_total(rows, [*kind, "__mix_hash", "__mix_row"], "__mix_one", "__mix_number", "mix-part")
    before = Window.orderBy(*kind).rowsBetween(Window.unboundedPreceding, -1)
    offsets = kinds.select(*[F.col(c).alias(f"__o{c}") for c in kind], F.coalesce(F.sum("__mix_repeats").over(before), F.lit(0)).alias("__mix_before"))  # one row a source at most
    rows = rows.join(F.broadcast(offsets), [F.col(c).eqNullSafe(F.col(f"__o{c}")) for c in kind])
    times = F.col("__mix_epochs") + F.when(F.col("__mix_number") - F.col("__mix_before") <= F.col("__mix_part"), 1).otherwise(0)
    return rows.withColumn("__mix_times", times).select(*found.columns)
