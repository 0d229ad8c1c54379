"""From atoms to predictions: one plan over all files."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residuum.functions import lookup
from residuum.functions import rules as R
from residuum.operators import curate, learn, residue, transfer, trees
from residuum.operators import windows as W
from residuum.sources import structure
from residuum.sources.labels import ATOMS

KEY = residue.KEY


def single(atoms: DataFrame, scores: DataFrame, dssp: DataFrame | None = None, flank: int = 0, ph: DataFrame | None = None, default_ph: float = 5.0, restrict_ha: bool = True, in_order: bool = False) -> DataFrame:
    """A row a residue, from one place an atom. With ``dssp`` residues that it lacks are dropped, as without an assignment they are unusable.

    ``ph``: file_id, ph; other files have the default. ``in_order``: fail where a chain's numbers repeat or fall along the file.
    """
    everything = structure.one_place(atoms)
    atoms = residue.standard(everything)
    ids = atoms.groupBy(*KEY, F.col("resname").alias("RESNAME")).agg(F.min("pos").alias("__pos"))
    if in_order:
        ids = curate.check_order(ids, KEY[:-1], "__pos", "res_num")
    ids = ids.drop("__pos")
    parts = [residue.torsions(atoms), residue.side_torsions(atoms), residue.hydrogen_bonds(atoms, restrict_ha=restrict_ha, around=everything), residue.contact_order(atoms), residue.substitution_row(atoms, scores), residue.exposure(atoms), residue.ring_currents(atoms), residue.mean_bfactor(atoms), residue.oxidised(atoms)]
    table = reduce(lambda a, b: a.join(b, KEY, "left"), parts, ids)
    table = with_ph(table, ph, default_ph)
    if dssp is not None:
        table = table.join(residue.accessible(dssp).drop("resname"), KEY)
    if flank:
        table = W.flanks(table, KEY[:-1], ["res_num"], "RESNAME", flank)
    return table


def triple(table: DataFrame, coil: DataFrame) -> DataFrame:
    """Features of the residue and both neighbours by number, and random-coil values in the context of the next residue."""
    own = {"RESNAME", "CYS_OX", "PH", *KEY}
    shared = [c for c in table.columns if c not in own and not c.endswith("_RC") and not c.startswith("RESNAME_")]
    wide = W.guarded(table, KEY[:-1], "res_num", {c: 0.0 for c in shared} | {"RESNAME": ""})
    wide = transfer.with_context(wide, KEY[:-1], "res_num", "RESNAME")
    values = coil.groupBy("context", F.col("resname").alias("RESNAME")).pivot("atom", list(ATOMS)).agg(F.max("value"))
    wide = wide.join(F.broadcast(values), ["context", "RESNAME"], "left")  # 40 rows
    shift = {f"RCOIL_{a}": F.col(a) + F.when(F.col("CYS_OX"), lookup.OXIDISED_CYS[a]).otherwise(0.0) for a in ATOMS}
    return wide.withColumns(shift).drop("context", "CYS_OX", *ATOMS)


def preprocess(table: DataFrame, alphas: str = "mean") -> DataFrame:
    """Ring currents of both alpha hydrogens merged (``alphas``: their mean, or one of them by name), hydrophobicity, powers of distances and cosines."""
    if "HA2_RC" in table.columns:
        merged = {"mean": (F.col("HA2_RC") + F.col("HA3_RC")) / 2, "HA2": F.col("HA2_RC"), "HA3": F.col("HA3_RC")}[alphas]
        ha = F.when(F.col("HA2_RC").isNotNull(), merged).otherwise(F.col("HA_RC"))
        table = table.withColumn("HA_RC", ha).drop("HA2_RC", "HA3_RC")
    energies = F.create_map(*[F.lit(v) for kv in lookup.HYDROPHOBICITY.items() for v in kv])
    distances = [c for c in table.columns if c.split("_")[1:2] == ["d"]]
    cosines = [c for c in table.columns if "_COS" in c]
    powers = {f"{c}^2": R.power(F.col(c), 2) for c in distances + cosines} | {f"{c}^{p}": R.power(F.col(c), p) for c in distances for p in (-1, -2, -3)}
    return table.withColumn("HYDROPHOBICITY", F.try_element_at(energies, F.col("RESNAME"))).withColumns(powers)


def for_atom(table: DataFrame, atom: str) -> list[str]:
    """The model's inputs for an atom, in their fixed order: names, but for ids, coil values and other atoms' ring currents."""
    drop = {*KEY, "RESNAME", "RESNAME_im1", "RESNAME_ip1", *(f"{a}_RC" for a in (*ATOMS, "HA2", "HA3") if a != atom), *(f"RCOIL_{a}" for a in ATOMS)}
    return sorted(c for c in table.columns if c not in drop)


def training_table(table: DataFrame, labels: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Features with the labels of their residues, null where there is none.

    ``labels``: file_id, chain, resid and any of the six atoms (others are added as null). ``pairs`` (file_id, chain, feature_no, label_no) says which residue
    of the labels, by ordinal, belongs to which of the features; without it their numbers agree.
    """
    labels = labels.withColumns({a: F.lit(None).cast("double") for a in ATOMS if a not in labels.columns})
    where = KEY[:1] + KEY[2:3]
    named = labels.select(*where, "resid", *ATOMS)
    if pairs is None:
        return table.join(named.withColumnRenamed("resid", "res_num"), [*where, "res_num"], "left")
    told = Window.partitionBy(*where).orderBy("resid")
    named = named.withColumn("label_no", F.row_number().over(told)).join(pairs, [*where, "label_no"]).drop("label_no", "resid")
    numbered = table.withColumn("feature_no", F.row_number().over(Window.partitionBy(*KEY[:-1]).orderBy("res_num")))
    return numbered.join(named, [*where, "feature_no"], "left").drop("feature_no")


def less_baselines(table: DataFrame, rings: bool = False) -> DataFrame:
    """Labels of the six atoms less their random-coil values (missing ones make a label missing); with ``rings`` also less ring currents.

    A missing ring current counts as its column's median over all rows (0 where the column has no value), so with ``rings`` out of folds only.
    """
    named = [a for a in ATOMS if a in table.columns]
    near = [a for a in named if rings and f"{a}_RC" in table.columns]
    if near:
        columns = [f"{a}_RC" for a in near]
        table = curate.impute(table, curate.medians(table, columns, skip_zero=False), zero=False)
    filled = {a: [F.col(f"{a}_RC")] if a in near else [] for a in named}
    return table.withColumns({a: R.less_baselines(F.col(a), filled=filled[a], required=[F.col(f"RCOIL_{a}")]) for a in named})


QUALITY = {"SCORE": "score", "COV": "cov", "MATCH": "match"}


def with_transferred(table: DataFrame, transferred: DataFrame, base: Column) -> DataFrame:
    """``table`` with ``valid``, ``VALUE`` as transferred, ``Y`` (it less ``base``) and the qualities SCORE, COV and MATCH.

    ``transferred``: KEY, RESNAME, value, score, cov, match, one row a residue. Where a residue has none, its file has none at all, or the residue names differ, nothing is
    valid: Y is null and the qualities are 0. The same for training and for prediction.
    """
    y = transferred.select(*KEY, F.col("RESNAME").alias("__name"), F.col("value").alias("VALUE"), *[F.col(c).alias(f"__{c}") for c in QUALITY.values()])
    rows = table.join(y, KEY, "left").withColumn("valid", F.coalesce((F.col("RESNAME") == F.col("__name")) & F.col("VALUE").isNotNull(), F.lit(False)))
    more = {"Y": F.when(F.col("valid"), F.col("VALUE") - base)} | {n: F.when(F.col("valid"), F.col(f"__{c}")).otherwise(0.0) for n, c in QUALITY.items()}
    return rows.withColumns(more).drop("__name", *[f"__{c}" for c in QUALITY.values()])


def with_ph(table: DataFrame, ph: DataFrame | None, default: float = 5.0) -> DataFrame:
    """``table`` with ``PH``: that of its file (``ph``: file_id, ph; the least of several), else the default."""
    if ph is None:
        return table.withColumn("PH", F.lit(default))
    return table.join(ph.groupBy("file_id").agg(F.min("ph").alias("PH")), "file_id", "left").withColumn("PH", F.coalesce("PH", F.lit(default)))


def predict(table: DataFrame, atom: str, models: dict[str, trees.Forest | RandomForestRegressionModel], transferred: DataFrame | None = None) -> DataFrame:
    """``KEY, RESNAME, <atom>_X`` and, with ``transferred`` (see ``with_transferred``), the combined prediction with its fallback.

    The transferred value counts only where the residue names agree.
    """
    base = F.col(f"RCOIL_{atom}")
    inputs = for_atom(table, atom)
    step = lambda df, names, model, out: model.transform(learn.assembled(df, names)).withColumnRenamed("pred", out).drop("features")
    rows = trees.predict(table.na.fill(0.0, inputs), models["r0"], "r0_pred")
    rows = step(rows, [*inputs, "r0_pred"], models["r1"], "r1_pred")
    if transferred is None:
        return rows.select(*KEY, "RESNAME", (F.col("r1_pred") + base).alias(f"{atom}_X"))
    rows = with_transferred(rows, transferred, base).na.fill(0.0, ["Y"])
    rows = step(rows, [*inputs, "Y", *QUALITY, "r0_pred"], models["r2"], "r2_pred")
    final = learn.fallback(F.col("valid"), F.col("r2_pred"), F.col("r1_pred"), base)
    return rows.select(*KEY, "RESNAME", (F.col("r1_pred") + base).alias(f"{atom}_X"), F.col("VALUE").alias(f"{atom}_Y"), final.alias(f"{atom}_final"))


def predict_transfer(residues: DataFrame, candidates: DataFrame, caps: dict[str, float] = transfer.CAPS) -> DataFrame:
    """Values of all query residues from the labels of their hits, one row a residue and atom.

    ``residues``: query, RESNUM, RESNAME; ``candidates``: query, RESNUM, atom, ordinal, value (secondary), score, similarity, tmscore, rmsd,
    coverage, identity, same. Without a hit the value is null and the quality columns are 0.
    """
    weight = R.softmax_weight(F.col("score"), F.col("similarity"))
    keys = ["query", "RESNUM", "atom"]
    cap = F.create_map(*[F.lit(v) for kv in caps.items() for v in kv])
    value = transfer.weighted_mean(candidates, keys, "value", weight).withColumn("value", R.clip(F.col("value"), F.try_element_at(cap, F.col("atom"))))
    best = transfer.best_reference(candidates.withColumn("__w", F.when(F.col("value").isNotNull(), weight)), keys, F.col("__w"), "ordinal")
    best = best.select(*keys, (F.col("tmscore") * F.exp(-F.col("rmsd"))).alias("BEST_REF_SCORE"), F.least("coverage", "identity").alias("BEST_REF_COV"), F.col("same").cast("double").alias("BEST_REF_MATCH"))
    wanted = residues.withColumn("atom", F.explode(F.array(*[F.lit(a) for a in ATOMS])))
    return transfer.or_default(wanted, value.join(best, keys), keys, ["BEST_REF_SCORE", "BEST_REF_COV", "BEST_REF_MATCH"])
