"""Secondary structure and surface from coordinates, where no outside program's table is at hand.

Secondary structure is by hydrogen bonds of the backbone (Kabsch and Sander): a bond is an electrostatic energy below -0.5 kcal/mol between the CO of one residue and the NH of
another, the two best of each NH. Turns are bonds that reach 3, 4 or 5 residues on, helices two turns in a row; bridges are the bond table joined with
itself in the four patterns of parallel and antiparallel neighbours, and a bridge next to one of its kind makes a ladder. Residues are numbered by structure,
with a jump at chain ends and breaks, so every pattern is an equality of numbers.

The surface is that of a probe rolled over the heavy atoms (Shrake and Rupley): points on a sphere around each atom, without those inside a neighbour's. Neighbours
come from the grid join; they are few, as atoms keep apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residuum.functions import lookup
from residuum.functions import vectors as V
from residuum.operators import keys as K
from residuum.operators import spatial
from residuum.operators.residue import KEY, STRUCTURE, places
from residuum.session import stash

# Van der Waals radii in angstroms (Bondi 1964); other elements count as carbon.
RADII = {"C": 1.7, "N": 1.55, "O": 1.52, "S": 1.8}
PROBE = 1.4
#: Numbers that are left out at a break of the chain, more than any pattern spans.
JUMP = 10
#: Residue numbers of a chain that are counted in one go.
STRETCH = 2_000
#: Longest bond between residues in a chain, and farthest CA of residues that may be bonded.
LINK, REACH = 2.5, 9.0


def backbone(atoms: DataFrame) -> DataFrame:
    """``KEY, resname, at`` and N, CA, C, O, H as structs, of residues with the first four; a missing H is placed 1 angstrom from N, away from the previous residue's O.

    Chains are cut into stretches of residue numbers. Each hands its last residue to the next one and its count on, so a long structure is many tasks' work.
    """
    part = [*STRUCTURE, "chain", "__part"]
    own, parts = Window.partitionBy(*part).orderBy("res_num"), Window.partitionBy(*STRUCTURE).orderBy("chain", "__part")
    rows = places(atoms, ["N", "CA", "C", "O", "H"]).filter("N IS NOT NULL AND CA IS NOT NULL AND C IS NOT NULL AND O IS NOT NULL")
    rows = stash(rows.withColumn("__part", F.floor(F.col("res_num") / STRETCH)), "backbone-places")  # read twice below, and so is what follows
    last = rows.groupBy(*part).agg(F.max_by(F.struct("C", "O", "chain"), F.coalesce("res_num", F.lit(0))).alias("last"))
    handed = last.select(*part, F.lag("last").over(parts).alias("__handed"))
    rows = K.join(rows.withColumn("__before", F.lag(F.struct("C", "O", "chain")).over(own)), handed, part)
    rows = rows.withColumn("__before", F.coalesce("__before", "__handed")).drop("__handed")
    linked = F.coalesce((F.col("__before.chain") == F.col("chain")) & (V.distance(V.vec("__before.C"), V.vec("N")) <= LINK), F.lit(False))
    rows = stash(rows.withColumn("__linked", linked), "backbone-linked")
    step = F.when(F.col("__linked"), 1).otherwise(JUMP)
    counts = rows.groupBy(*part).agg(F.sum(step).alias("__sum"))
    offsets = counts.select(*part, F.coalesce(F.sum("__sum").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    rows = K.join(rows.withColumn("__own", F.sum(step).over(own.rowsBetween(Window.unboundedPreceding, 0))), offsets, part)
    away = V.sub(V.vec("__before.C"), V.vec("__before.O"))
    size = V.norm(away)
    placed = F.when(F.col("__linked") & (size > 0), F.struct(*[(F.col("N")[c] + a / size).alias(c) for c, a in zip("xyz", away)]))
    hydrogen = F.when(F.col("resname") != "PRO", F.coalesce("H", placed))
    return rows.select(*KEY, "resname", (F.col("__offset") + F.col("__own")).alias("at"), "N", "CA", "C", "O", hydrogen.alias("H"))


def backbone_bonds(rows: DataFrame) -> DataFrame:
    """``STRUCTURE, co, nh, energy``: bonds from the CO of number ``co`` to the NH of number ``nh``, the two best of each NH."""
    tips = rows.select(*STRUCTURE, "at", "N", "H", "C", "O", F.col("CA.x").alias("x"), F.col("CA.y").alias("y"), F.col("CA.z").alias("z"))
    pairs = spatial.radius_join(tips.filter("H IS NOT NULL").drop("C", "O"), tips.drop("N", "H"), REACH, STRUCTURE).filter((F.col("at") != F.col("o_at")) & (F.col("at") != F.col("o_at") + 1))
    n, h, c, o = V.vec("N"), V.vec("H"), V.vec("o_C"), V.vec("o_O")
    far = [V.distance(o, n), V.distance(c, h), V.distance(o, h), V.distance(c, n)]
    energy = 0.084 * 332 * (F.try_divide(F.lit(1.0), far[0]) + F.try_divide(F.lit(1.0), far[1]) - F.try_divide(F.lit(1.0), far[2]) - F.try_divide(F.lit(1.0), far[3]))
    found = pairs.select(*STRUCTURE, F.col("o_at").alias("co"), F.col("at").alias("nh"), energy.alias("energy")).filter("energy < -0.5")
    best = Window.partitionBy(*STRUCTURE, "nh").orderBy("energy", "co")
    return found.withColumn("__k", F.row_number().over(best)).filter("__k <= 2").drop("__k")


def bridges(bonds: DataFrame) -> DataFrame:
    """``STRUCTURE, i, j, parallel``: each bridge in both orders."""
    a = bonds.select(*STRUCTURE, F.col("co").alias("a1"), F.col("nh").alias("a2"))
    b = bonds.select(*STRUCTURE, F.col("co").alias("b1"), F.col("nh").alias("b2"))
    # pairs of bonds, and the residues i and j that they make neighbours: CO of i - 1 to NH of j and CO of j to NH of i + 1; CO of i to NH of j and
    # back; CO of i - 1 to NH of j + 1 and CO of j - 1 to NH of i + 1
    patterns = [
        ((F.col("a2") == F.col("b1")) & (F.col("b2") == F.col("a1") + 2), F.col("a1") + 1, F.col("a2"), True),
        ((F.col("a2") == F.col("b1")) & (F.col("a1") == F.col("b2")), F.col("a1"), F.col("a2"), False),
        ((F.col("b1") == F.col("a2") - 2) & (F.col("b2") == F.col("a1") + 2), F.col("a1") + 1, F.col("a2") - 1, False),
    ]
    same = reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in STRUCTURE])
    found = [a.join(b, same & on).select(*[a[k] for k in STRUCTURE], i.alias("i"), j.alias("j"), F.lit(parallel).alias("parallel")) for on, i, j, parallel in patterns]
    one = reduce(DataFrame.unionByName, found).filter(F.abs(F.col("i") - F.col("j")) >= 3)
    return one.unionByName(one.select(*STRUCTURE, F.col("j").alias("i"), F.col("i").alias("j"), "parallel")).distinct()


def secondary(atoms: DataFrame) -> DataFrame:
    """``KEY, resname, ss``: H, B, E, G, I, T, S or - of each residue with a whole backbone."""
    # read many times below
    rows = stash(backbone(atoms), "backbone")
    bonds = stash(backbone_bonds(rows), "backbone-bonds")
    flags = []
    for reach, name in ((4, "H"), (3, "G"), (5, "I")):
        turn = bonds.filter(F.col("nh") == F.col("co") + reach).select(*STRUCTURE, F.col("co").alias("t")).distinct()
        inside = turn.select(*STRUCTURE, F.explode(F.sequence(F.col("t") + 1, F.col("t") + reach - 1)).alias("at"), F.lit("T").alias("flag"))
        pair = turn.join(turn.select(*STRUCTURE, (F.col("t") + 1).alias("t")), [*STRUCTURE, "t"])  # a turn here and one before
        flags += [inside, pair.select(*STRUCTURE, F.explode(F.sequence(F.col("t"), F.col("t") + reach - 1)).alias("at"), F.lit(name).alias("flag"))]
    found = stash(bridges(bonds), "bridges")
    # the next bridge of a ladder goes on along both strands, in the same sense or against each other
    ahead = found.select(*STRUCTURE, (F.col("i") - 1).alias("i"), F.when(F.col("parallel"), F.col("j") - 1).otherwise(F.col("j") + 1).alias("j"), "parallel")
    behind = found.select(*STRUCTURE, (F.col("i") + 1).alias("i"), F.when(F.col("parallel"), F.col("j") + 1).otherwise(F.col("j") - 1).alias("j"), "parallel")
    ladder = found.join(ahead.unionByName(behind).distinct().withColumn("__next", F.lit(True)), [*STRUCTURE, "i", "j", "parallel"], "left")
    flags.append(ladder.select(*STRUCTURE, F.col("i").alias("at"), F.when(F.col("__next"), "E").otherwise("B").alias("flag")))
    # numbers go up by one or by a jump, so none is missing between two that are two apart
    two_off = lambda k, name: rows.select(*STRUCTURE, (F.col("at") + k).alias("at"), F.col("CA").alias(name))
    bent = rows.select(*STRUCTURE, "at", "CA").join(two_off(2, "__a"), [*STRUCTURE, "at"]).join(two_off(-2, "__b"), [*STRUCTURE, "at"])
    turned = V.cos_angle(V.vec("__a"), V.vec("CA"), V.vec("__b"))  # 180 degrees less the bend
    flags.append(bent.filter(-turned < F.cos(F.radians(F.lit(70.0)))).select(*STRUCTURE, "at", F.lit("S").alias("flag")))
    all_ = reduce(DataFrame.unionByName, flags).groupBy(*STRUCTURE, "at").agg(F.collect_set("flag").alias("f"))
    # a residue of a ladder isn't a single bridge as well
    ss = F.lit("-")
    for letter in reversed("HEBGITS"):
        ss = F.when(F.array_contains("f", letter), letter).otherwise(ss)
    return rows.join(all_, [*STRUCTURE, "at"], "left").select(*KEY, "resname", F.coalesce(F.when(F.col("f").isNotNull(), ss), F.lit("-")).alias("ss"))


def _radius(element: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in RADII.items() for v in kv]), element), F.lit(RADII["C"])) + PROBE


def surface(atoms: DataFrame, points: int = 92) -> DataFrame:
    """``KEY, asa``: the accessible surface of each residue's heavy atoms in square angstroms, in the structure as it is given."""
    heavy = atoms.filter(~F.col("element").isin("H", "D")).select(*KEY, "pos", "x", "y", "z", _radius(F.col("element")).alias("r"))
    near = spatial.radius_join(heavy, heavy, 2 * (max(RADII.values()) + PROBE), STRUCTURE).filter((F.col("pos") != F.col("o_pos")) & (F.col("dist") < F.col("r") + F.col("o_r")))
    around = near.groupBy(*STRUCTURE, "pos").agg(F.array_sort(F.collect_list(F.struct("dist", F.col("o_x").alias("x"), F.col("o_y").alias("y"), F.col("o_z").alias("z"), F.col("o_r").alias("r")))).alias("around"))  # atoms that touch
    rows = heavy.join(around, [*STRUCTURE, "pos"], "left")

    def free(k: Column) -> Column:
        """Whether the k-th point of a spiral over the sphere is outside all neighbours."""
        up = 1 - (2 * k + 1) / points
        side, angle = F.sqrt(1 - up * up), k * 2.399963229728653  # the golden angle
        p = [F.col("x") + F.col("r") * side * F.cos(angle), F.col("y") + F.col("r") * side * F.sin(angle), F.col("z") + F.col("r") * up]
        inside = lambda o: sum(((a - o[c]) * (a - o[c]) for a, c in zip(p, "xyz")), F.lit(0.0)) < o["r"] * o["r"]
        return ~F.coalesce(F.exists("around", inside), F.lit(False))

    share = F.size(F.filter(F.sequence(F.lit(0), F.lit(points - 1)), free)) / points
    area = F.sum(share * 4 * 3.141592653589793 * F.col("r") * F.col("r"))
    return rows.groupBy(*KEY).agg(area.alias("asa"))


def assigned(atoms: DataFrame, points: int = 92) -> DataFrame:
    """``KEY, resname, ss, rel_asa``, what ``residue.accessible`` takes: secondary structure, and the surface as a share of the residue's largest."""
    most = F.try_element_at(F.create_map(*[F.lit(v) for kv in lookup.MAX_ASA.items() for v in kv]), F.col("resname"))
    return secondary(atoms).join(surface(atoms, points), KEY).withColumn("rel_asa", F.col("asa") / most).drop("asa")
