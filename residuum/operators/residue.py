"""Features of residues from the atom table: torsions, contacts, hydrogen bonds, exposure, ring currents, B-factors.

Atoms are rows (see sources.structure); every operator is a join or a window keyed by file, model and chain, so one plan covers
all files. Absent features are 0, as consumers expect.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residuum.functions import lookup
from residuum.functions import rules as R
from residuum.functions import vectors as V
from residuum.operators import spatial

STRUCTURE = ["file_id", "model"]
KEY = [*STRUCTURE, "chain", "res_num"]


def standard(atoms: DataFrame) -> DataFrame:
    """Atoms of standard residues without an insertion code."""
    return atoms.filter((F.col("icode") == "") & ~F.col("het") & F.col("resname").isin(list(lookup.HYDROPHOBICITY)))


def places(atoms: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row a residue with the place of each named atom as struct<x,y,z>, null if it is missing."""
    point = F.struct("x", "y", "z")
    return atoms.groupBy(*KEY, "resname").agg(*[F.max(F.when(F.col("atom_name") == n, point)).alias(n) for n in names])


def _chain():
    return Window.partitionBy(*STRUCTURE, "chain").orderBy("res_num")


def torsions(atoms: DataFrame, longest_bond: float = 2.1) -> DataFrame:
    """``KEY, PHI_COS, PHI_SIN, PSI_COS, PSI_SIN``: across a peptide bond only where C and N are near each other."""
    w = _chain()
    rows = places(atoms, ["N", "CA", "C"]).withColumns({"C_im1": F.lag("C").over(w), "N_ip1": F.lead("N").over(w)})
    bound = lambda c, n: F.coalesce(V.distance(V.vec(c), V.vec(n)) <= longest_bond, F.lit(False))
    phi = F.when(bound("C_im1", "N"), V.dihedral(V.vec("C_im1"), V.vec("N"), V.vec("CA"), V.vec("C")))
    psi = F.when(bound("C", "N_ip1"), V.dihedral(V.vec("N"), V.vec("CA"), V.vec("C"), V.vec("N_ip1")))
    out = {}
    for name, angle in (("PHI", phi), ("PSI", psi)):
        out[f"{name}_COS"], out[f"{name}_SIN"] = V.cos_sin(angle)
    return rows.select(*KEY, *[c.alias(n) for n, c in out.items()])


def side_torsions(atoms: DataFrame, chis: Sequence[int] = (1, 2)) -> DataFrame:
    """``KEY, CHI1_COS, CHI1_SIN, CHI1_EXISTS, CHI2_...``: 0, 0, 0 where an atom is missing or the residue has no such angle."""
    defs = lookup.chi_table(atoms.sparkSession)
    point = F.struct("x", "y", "z")
    found = atoms.join(F.broadcast(defs), ["resname", "atom_name"])  # about 200 rows
    quads = found.groupBy(*KEY, "chi").agg(*[F.max(F.when(F.col("k") == k, point)).alias(f"p{k}") for k in range(4)])
    angle = V.dihedral(*[V.vec(f"p{k}") for k in range(4)])
    cos, sin = V.cos_sin(angle)
    each = quads.select(*KEY, "chi", cos.alias("COS"), sin.alias("SIN"), angle.isNotNull().cast("int").alias("EXISTS"))
    wide = each.groupBy(*KEY).agg(*[F.max(F.when(F.col("chi") == c, F.col(p))).alias(f"CHI{c}_{p}") for c in chis for p in ("COS", "SIN", "EXISTS")])
    return atoms.select(*KEY).distinct().join(wide, KEY, "left").na.fill(0)


def contact_order(atoms: DataFrame, radius: float = 10.0) -> DataFrame:
    """``KEY, S2``: heavy atoms around the previous residue's O and the own H, other residues' only."""
    named = places(atoms, ["O", "H", "1H"]).withColumn("previous", F.when(F.lag("res_num").over(_chain()) == F.col("res_num") - 1, F.lag("O").over(_chain())))
    probes = named.select(*KEY, F.explode(F.array("previous", F.coalesce("H", "1H"))).alias("p")).filter("p IS NOT NULL").select(*KEY, "p.*")
    heavy = atoms.filter(~F.contains("atom_name", F.lit("H")))
    near = spatial.radius_join(probes, heavy, radius, STRUCTURE).filter("dist > 0.1")
    own = (F.col("chain") == F.col("o_chain")) & F.col("o_res_num").isin(F.col("res_num"), F.col("res_num") - 1)
    sums = spatial.contact_sum(near.filter(~own), KEY)
    return named.select(*KEY).join(sums, KEY, "left").select(*KEY, R.contact_order(F.coalesce("contact", F.lit(0.0))).alias("S2"))


#: The cosine that stands for the acceptor's angle where the acceptor has no neighbour in its residue (water).
ALONE = 109.5


def bond_candidates(probes: DataFrame, atoms: DataFrame, elements: Sequence[str], skip: Sequence[int], radius: float = 5.0, third: str | None = None, also: Sequence[str] = ()) -> DataFrame:
    """All pairs of a probe and an atom of ``elements`` near it, with both cosines and the energy.

    ``probes``: KEY, structs a0, a1 (a1 carries the bond) and any columns ``also``. Left out are atoms of the own residue and of its neighbours at ``skip``.
    The angle at the other atom is to ``third``, an atom of its residue by name, else to that residue's nearest N, C or O;
    where there is none the atom stands ``alone``: 109.5 degrees and energy 0.
    """
    tips = probes.select(*KEY, "a0", "a1", *also, F.col("a1.x").alias("x"), F.col("a1.y").alias("y"), F.col("a1.z").alias("z"))
    wanted = atoms.filter(F.col("element").isin(list(elements)))
    near = spatial.radius_join(tips, wanted, radius, STRUCTURE).filter((F.col("dist") > 0.5) & (F.col("dist") < radius))
    own = (F.col("chain") == F.col("o_chain")) & F.col("o_res_num").isin(F.col("res_num"), *[F.col("res_num") + k for k in skip])
    near = near.filter(~own)
    mates = atoms.filter(F.col("atom_name") == third if third else F.col("element").isin("N", "C", "O"))
    place = F.struct(F.col("m_x").alias("x"), F.col("m_y").alias("y"), F.col("m_z").alias("z")).alias("a3")
    if third:
        mates = mates.groupBy(*KEY).agg(F.min_by(F.struct("x", "y", "z"), "pos").alias("a3"))
        near = near.join(mates.select(*STRUCTURE, F.col("chain").alias("o_chain"), F.col("res_num").alias("o_res_num"), "a3"), [*STRUCTURE, "o_chain", "o_res_num"], "left")
    else:
        mates = spatial.radius_join(wanted, mates, radius, KEY, prefix="m_").filter((F.col("dist") > 0.5) & (F.col("dist") < radius))
        mates = spatial.nth_nearest(mates, [*STRUCTURE, "pos"], ["dist", "m_pos"]).select(*STRUCTURE, F.col("pos").alias("o_pos"), place)
        near = near.join(mates, [*STRUCTURE, "o_pos"], "left")
    a0, a1, a2, a3 = V.vec("a0"), V.vec("a1"), V.columns("o_x", "o_y", "o_z"), V.vec("a3")
    alone = F.col("a3").isNull()
    cos_h, cos_a = V.cos_angle(a0, a1, a2), F.when(alone, F.cos(F.radians(F.lit(ALONE)))).otherwise(V.cos_angle(a1, a2, a3))
    energy = F.when(alone, 0.0).otherwise(R.hbond_energy(V.distance(a0, a2), V.distance(a1, a3), F.col("dist"), V.distance(a0, a3)))
    return near.withColumns({"cos_h": cos_h, "cos_a": cos_a, "energy": energy, "alone": alone})


def bond_holds(by_energy: bool = False) -> Column:
    """Both angles are 90 degrees or more and, if asked for, the energy is -0.5 or less (which isn't asked of an atom alone)."""
    angles = (F.col("cos_h") <= 1e-12) & (F.col("cos_a") <= 1e-12)
    return angles & (F.col("alone") | (F.col("energy") <= -0.5)) if by_energy else angles


def _five(found: DataFrame, probes: DataFrame, prefix: str, exists: Column) -> DataFrame:
    names = {"d": F.col("dist"), "COS_A": F.col("cos_a"), "COS_H": F.col("cos_h"), "EXISTS": exists, "ENERGY": F.col("energy")}
    bond = found.select(*KEY, *[c.cast("double").alias(f"{prefix}_{n}") for n, c in names.items()])
    return probes.select(*KEY).join(bond, KEY, "left").na.fill(0.0)


def bonds(probes: DataFrame, atoms: DataFrame, elements: Sequence[str], skip: int, radius: float = 5.0, prefix: str = "HN", by_energy: bool = False) -> DataFrame:
    """``KEY`` and the bond of each probe: distance, two cosines, whether there is one, energy; zeros without. The nearest candidate that holds counts."""
    scored = bond_candidates(probes, atoms, elements, (skip,), radius)
    return _five(spatial.first_valid(scored, KEY, bond_holds(by_energy), ["dist", "o_pos"]), probes, prefix, F.lit(1))


def alpha_bonds(probes: DataFrame, atoms: DataFrame, radius: float = 5.0, energy_of_own: bool = True, prefix: str = "Ha") -> DataFrame:
    """Bonds of alpha hydrogens to O, not of the own residue or either neighbour; the angle at the O is to its residue's carbonyl C.

    The nearest candidate with both angles counts. It EXISTS if that very O, of the backbone or of a side chain, has a bond of its own (from its residue's
    C; to a hydrogen other than this one and not of its own or the next residue, below the energy cutoff if ``energy_of_own``) or is water's.
    """
    scored = bond_candidates(probes, atoms, ["O"], (-1, 1), radius, third="C")
    found = spatial.first_valid(scored, KEY, bond_holds(), ["dist", "o_pos"])
    place = F.struct(F.col("o_x").alias("x"), F.col("o_y").alias("y"), F.col("o_z").alias("z"))
    acceptors = found.filter("NOT alone").select(*STRUCTURE, F.col("o_chain").alias("chain"), F.col("o_res_num").alias("res_num"), F.col("a3").alias("a0"), place.alias("a1"), F.col("o_pos").alias("acceptor")).distinct()
    own = bond_candidates(acceptors, atoms, ["H", "D"], (1,), radius, also=["acceptor"]).filter(bond_holds(energy_of_own))
    own = own.select(*STRUCTURE, F.col("acceptor").alias("o_pos"), F.struct("o_x", "o_y", "o_z").alias("at"))
    tip = F.struct(F.col("a1.x").alias("o_x"), F.col("a1.y").alias("o_y"), F.col("a1.z").alias("o_z"))
    others = found.select(*KEY, "o_pos", tip.alias("tip")).join(own, [*STRUCTURE, "o_pos"]).filter("at <> tip").select(*KEY).distinct().withColumn("bound", F.lit(1))
    return _five(found.join(others, KEY, "left"), probes, prefix, F.when(F.col("alone"), 1).otherwise(F.coalesce("bound", F.lit(0))))


def hydrogen_bonds(atoms: DataFrame, radius: float = 5.0, by_energy: bool = False, restrict_ha: bool = True, around: DataFrame | None = None, energy_of_own: bool = True) -> DataFrame:
    """``KEY`` and five values for each of HA (from CA), HN (from N) and O (from C).

    HN binds N and O, O binds H and D. ``around``: all atoms of the structures, with water, where ``atoms`` are those of residues alone.
    ``restrict_ha``: HA as in ``alpha_bonds``, else like HN.
    """
    around = atoms if around is None else around
    at = places(atoms, ["CA", "HA", "1HA", "N", "H", "1H", "H1", "D", "1D", "D1", "C", "O"])

    def probes(base: str, tips: Sequence[str]) -> DataFrame:
        return at.select(*KEY, F.col(base).alias("a0"), F.coalesce(*[F.col(f"`{t}`") for t in tips]).alias("a1")).filter("a0 IS NOT NULL AND a1 IS NOT NULL")

    ha, hn, o = probes("CA", ["HA", "1HA"]), probes("N", ["H", "1H", "H1", "D", "1D", "D1"]), probes("C", ["O"])
    parts = [
        alpha_bonds(ha, around, radius, energy_of_own) if restrict_ha else bonds(ha, around, ["N", "O"], -1, radius, "Ha", by_energy),
        bonds(hn, around, ["N", "O"], -1, radius, "HN", by_energy),
        bonds(o, around, ["H", "D"], 1, radius, "O", by_energy),
    ]
    out = at.select(*KEY)
    for part in parts:
        out = out.join(part, KEY, "left").na.fill(0.0)
    return out


def exposure(atoms: DataFrame, radius: float = 12.0) -> DataFrame:
    """``KEY`` and CA neighbours above and below: by the CA-CB direction, and by that away from the neighbouring CAs; the angle between the two directions (0 without)."""
    w = _chain()
    at = places(atoms, ["CA", "CB"]).withColumns({"before": F.lag("CA").over(w), "after": F.lead("CA").over(w)})
    cas = atoms.filter("atom_name = 'CA'")
    ca = V.vec("CA")
    unit = lambda v: tuple(F.try_divide(c, V.norm(v)) for c in v)
    side_chain = V.sub(V.vec("CB"), ca)
    away = tuple(a + b for a, b in zip(unit(V.sub(ca, V.vec("before"))), unit(V.sub(ca, V.vec("after")))))
    angle = F.acos(V.cos_angle(side_chain, (F.lit(0.0),) * 3, away))
    out = at.select(*KEY, F.coalesce(angle, F.lit(0.0)).alias("HSE_CA_ANGLE"))
    for name, direction in (("CB", side_chain), ("CA", away)):
        probes = at.select(*KEY, F.struct(*[c.alias(n) for c, n in zip(direction, "xyz")]).alias("to"), "CA.*").filter("x IS NOT NULL AND to.x IS NOT NULL")
        near = spatial.radius_join(probes, cas, radius, STRUCTURE).filter("dist > 0.1")
        side = V.dot(V.vec("to"), V.sub(V.columns("o_x", "o_y", "o_z"), V.columns("x", "y", "z")))
        counts = spatial.half_sphere(near, KEY, side).withColumnsRenamed({"up": f"HSE_{name}_U", "down": f"HSE_{name}_D"})
        out = out.join(counts, KEY, "left").na.fill(0)
    return out


def ring_currents(atoms: DataFrame) -> DataFrame:
    """``KEY`` and the ring current on each target atom as ``<atom>_RC``, null where the atom is missing."""
    table = lookup.ring_table(atoms.sparkSession)
    corner = F.struct("k", "x", "y", "z")
    rings = atoms.join(F.broadcast(table), ["resname", "atom_name"]).groupBy(*KEY, "ring_no", "intensity", "corners").agg(F.array_sort(F.collect_list(corner)).alias("c"))  # at most six
    rings = rings.filter(F.size("c") == F.col("corners")).select(*STRUCTURE, "intensity", F.transform("c", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"))).alias("ring"))
    pairs = lambda d: F.create_map(*[F.lit(v) for kv in d.items() for v in kv])
    name = F.coalesce(F.try_element_at(pairs(lookup.ATOM_ALIASES), F.col("atom_name")), F.col("atom_name"))
    targets = atoms.withColumn("target", name).withColumn("factor", F.try_element_at(pairs(lookup.RING_TARGETS), F.col("target"))).filter("factor IS NOT NULL")
    # a residue's atom under its plain name comes before one under another spelling
    plain = F.struct((F.col("atom_name") != F.col("target")).alias("other"), "pos")
    targets = targets.groupBy(*KEY, "target", "factor").agg(F.min_by(F.struct("x", "y", "z"), plain).alias("at")).select(*KEY, "target", "factor", "at.*")
    total = spatial.ring_current(targets, rings, STRUCTURE, [*KEY, "target"], F.col("intensity"), F.col("factor"))
    all_ = targets.select(*KEY, "target").distinct().join(total, [*KEY, "target"], "left").na.fill(0.0, ["ring"])
    return all_.groupBy(*KEY).pivot("target", list(lookup.RING_TARGETS)).agg(F.max("ring")).withColumnsRenamed({t: f"{t}_RC" for t in lookup.RING_TARGETS})


def mean_bfactor(atoms: DataFrame, six_only: bool = False) -> DataFrame:
    """``KEY, AVG_B``: of all atoms, or the sum over the six backbone atoms found by six."""
    six = F.sum(F.when(F.col("atom_name").isin("N", "CA", "C", "CB", "HA", "H"), F.col("bfactor"))) / 6
    return atoms.groupBy(*KEY).agg((six if six_only else F.avg("bfactor")).alias("AVG_B"))


def oxidised(atoms: DataFrame) -> DataFrame:
    """``KEY, CYS_OX``: whether the residue's SG is in a disulfide."""
    sulfurs = atoms.filter("atom_name = 'SG'")
    pairs = spatial.disulfides(sulfurs, STRUCTURE, "res_num").select(*KEY).distinct().withColumn("CYS_OX", F.lit(True))
    return atoms.select(*KEY).distinct().join(pairs, KEY, "left").na.fill(False)


def substitution_row(atoms: DataFrame, scores: DataFrame) -> DataFrame:
    """``KEY`` and BLOSUM_<residue>: scores of the residue against each of the 20; ``scores``: a, b, score in three letters, symmetric."""
    wide = scores.groupBy("a").pivot("b", sorted(lookup.HYDROPHOBICITY)).agg(F.max("score"))
    wide = wide.select(F.col("a").alias("resname"), *[F.col(r).alias(f"BLOSUM_{r}") for r in sorted(lookup.HYDROPHOBICITY)])
    return atoms.select(*KEY, "resname").distinct().join(F.broadcast(wide), "resname", "left").drop("resname")  # 20 rows


#: What an assignment program states of a residue besides its class and relative accessibility: backbone angles in degrees and the
#: energies of its hydrogen bonds as donor and acceptor (first and second best).
ASSIGNED = ("phi", "psi", "nh_o_1_energy", "o_nh_1_energy", "nh_o_2_energy", "o_nh_2_energy")


def accessible(dssp: DataFrame) -> DataFrame:
    """A table of secondary structure (KEY, resname, ss, rel_asa and, where stated, ``ASSIGNED``, which pass through) with eight flags and the absolute surface."""
    most = F.create_map(*[F.lit(v) for kv in lookup.MAX_ASA.items() for v in kv])
    return dssp.withColumn("ABS_ASA", F.col("rel_asa") * F.try_element_at(most, F.col("resname"))).withColumns({f"{c}_SS": (F.col("ss") == s).cast("int") for c, s in zip("HBEGITSx", "HBEGITS-")})

