"""Parsers, geometry and features on tiny structures with results by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from residuum.functions import label_text as L
from residuum.functions import vectors as V
from residuum.operators import residue, search, spatial, transfer
from residuum.plans import features
from residuum.sources import labels, reports, structure, text


def atom(serial, name, res, chain, num, x, y, z, b=1.0, icode=" ", alt=" ", element=None, het=False, occupancy=1.0):
    place = f" {name:<3}" if len(name) < 4 else name
    return f"{'HETATM' if het else 'ATOM  '}{serial:5d} {place}{alt}{res:>3} {chain}{num:4d}{icode}   {x:8.3f}{y:8.3f}{z:8.3f}{occupancy:6.2f}{b:6.2f}          {element or name[0]:>2}"


def peptide():
    """Three residues in a plane, and water."""
    rows, n = [], 0
    for k, res in enumerate(("ALA", "PHE", "PRO")):
        base = 3.8 * k
        for name, x, y, z in (("N", 0, 0, 0), ("CA", 1.2, 0.8, 0), ("C", 2.4, 0, 0), ("O", 2.4, -1.2, 0), ("CB", 1.2, 1.6, 1.2), ("H", 0, -1.0, 0), ("HA", 1.2, 1.4, -0.9)):
            n += 1
            rows.append(atom(n, name, res, "A", k + 1, base + x, y + (k % 2) * 0.3, z, b=10.0 * (k + 1)))
    for i, name in enumerate(("CG", "CD2", "CE2", "CZ", "CE1", "CD1")):
        n += 1
        rows.append(atom(n, name, "PHE", "A", 2, 5 + 1.4 * math.cos(i * math.pi / 3), 5 + 1.4 * math.sin(i * math.pi / 3), 2.0))
    rows.append(atom(n + 1, "O", "HOH", "A", 99, 20, 20, 20, het=True))
    return rows


def write(tmp_path, name, lines):
    (tmp_path / name).write_text("\n".join(lines) + "\n")
    return str(tmp_path / name)


@pytest.fixture
def atoms(spark, tmp_path):
    lines = ["HEADER x", "REMARK   2 RESOLUTION.    1.80 ANGSTROMS.", "MODEL        1", *peptide(), "ENDMDL", "MODEL        2", *peptide(), "ENDMDL"]
    return structure.atoms(text.numbered_lines(spark, write(tmp_path, "1abc.pdb", lines)))


def test_atoms_models_and_round_trip(spark, atoms, tmp_path):
    assert atoms.count() == 2 * len(peptide())
    assert structure.first_model(atoms).select("model").distinct().collect()[0].model == 1
    one = structure.first_model(atoms)
    back = [r.line for r in structure.as_lines(one).orderBy("pos").collect()]
    assert [x[:54] for x in back] == [x[:54] for x in peptide()]
    row = structure.sequences(one).collect()[0]
    assert (row.sequence, list(row.numbers)) == ("AFP", [1, 2, 3])


def test_repair_keeps_the_first_of_a_number_and_alternates(spark, tmp_path):
    lines = [atom(1, "CA", "MSE", "A", 1, 0, 0, 0), atom(2, "CA", "XYZ", "A", 2, 0, 0, 0), atom(3, "CA", "GLY", "A", 3, 0, 0, 0, alt="A", occupancy=0.3), atom(4, "CA", "GLY", "A", 3, 1, 0, 0, alt="B", occupancy=0.7), atom(5, "CA", "ALA", "A", 3, 9, 0, 0, icode="A")]
    table = structure.repair(structure.atoms(text.numbered_lines(spark, write(tmp_path, "x.pdb", lines))))
    got = {(r.res_num, r.resname, r.x) for r in structure.one_place(table).collect()}
    assert got == {(1, "MET", 0.0), (3, "GLY", 1.0)}


def test_the_place_with_the_highest_occupancy_reaches_features_and_files(spark, tmp_path):
    rows = [atom(1, "CA", "ALA", "A", 1, 0, 0, 0), atom(2, "CB", "ALA", "A", 1, 9, 9, 9, b=4, alt="A", occupancy=0.4), atom(3, "CB", "ALA", "A", 1, 1, 1, 1, b=2, alt="B", occupancy=0.6)]
    rows += [atom(4, "O", "ALA", "A", 1, 5, 0, 0, b=3, alt="A", occupancy=0.5), atom(5, "O", "ALA", "A", 1, 6, 0, 0, b=7, alt="B", occupancy=0.5)]
    table = structure.atoms(text.numbered_lines(spark, write(tmp_path, "alt.pdb", rows)))
    assert {(r.atom_name, r.altloc): r.occupancy for r in table.collect()}["CB", "B"] == 0.6
    assert {(r.atom_name, r.x) for r in structure.one_place(table).collect()} == {("CA", 0.0), ("CB", 1.0), ("O", 5.0)}
    assert [(r.line[30:38].strip(), r.line[54:60].strip()) for r in structure.as_lines(table).orderBy("pos").collect()] == [("0.000", "1.00"), ("1.000", "0.60"), ("5.000", "0.50")]
    scores = spark.createDataFrame([("ALA", "ALA", 4.0)], "a string, b string, score double")
    assert features.single(table, scores).collect()[0].AVG_B == pytest.approx((1 + 2 + 3) / 3)
    unstated = [x[:54] + " " * 6 + x[60:] for x in rows[1:2]] + rows[2:3]
    table = structure.atoms(text.numbered_lines(spark, write(tmp_path, "un.pdb", unstated)))
    assert [r.x for r in structure.one_place(table).collect()] == [1.0]


def test_free_text(spark, tmp_path):
    paths = [write(tmp_path, "a.txt", ["Details 'pH 6.5' at 298 K", "RESOLUTION. 1.80 ANGSTROMS."]), write(tmp_path, "b.txt", ["sample pH 7 . 10 mM", "none"]), write(tmp_path, "c.txt", ["nothing"])]
    lines = text.numbered_lines(spark, paths)
    assert {r.file: r.ph for r in text.ph(lines).collect()} == {"a": 6.5, "b": 7.0, "c": 5.0}
    assert {r.file: r.resolution for r in text.resolution(lines).collect()} == {"a": 1.8, "b": None, "c": None}
    fasta = text.numbered_lines(spark, write(tmp_path, "d.fa", [">one x", "ACD", "EF", ">two", "GH"]))
    assert {r.id: r.sequence for r in text.fasta(fasta).collect()} == {"one": "ACDEF", "two": "GH"}
    batch = text.numbered_lines(spark, write(tmp_path, "e.lst", ["x.pdb", "y.pdb 6.1", ""]))
    assert {r.path: r.ph for r in text.batch_list(batch).collect()} == {"x.pdb": 5.0, "y.pdb": 6.1}


def test_label_sections(spark, tmp_path):
    lines = ["REMARK S2 pH", "VARS RESID RESNAME ATOMNAME SHIFT", "FORMAT %4d", "", "1 A HN 8.1", "1\tA\tHA2\t4.0", "1 A HA3 5.0", "1 A CA 52.0", "1 A CA 53.0", "0 c CB 28.5", "", "RESID S2 RESNAME", "1 0.80 A", "0 0.70 G", "", "pH", "6.50"]
    table = text.numbered_lines(spark, write(tmp_path, "s.tab", lines))
    rows = labels.shifts(table)
    wide = {r.resid: r for r in labels.wide(rows).collect()}
    assert (wide[1].H, wide[1].HA, wide[1].CA, wide[0].CB, wide[0].H) == (8.1, 4.5, 53.0, 28.5, None)
    assert {r.resid: r.s2 for r in labels.order_parameters(table, rows).collect()} == {1: 0.8, 0: None}
    assert labels.stated_ph(table).collect()[0].ph == 6.5


def test_report_of_a_sequence_search(spark, tmp_path):
    lines = ["Sequences producing significant alignments:", "", "t1.A   250  1e-30", "t2.B   50  2e-3", "", ">t1.A", " Identities = 30/40 (75%), Positives = 1", "Query  1  ACDE  4", "Sbjct  3  AC-E  5", "Query  5  FG  6", "Sbjct  6  FG  7", " Identities = 5/9 (1%)", "Query  30  KK  31", ">t2.B", " Identities = 10/20 (50%)"]
    table = text.numbered_lines(spark, write(tmp_path, "blast.out", lines))
    got = {r.target: r for r in reports.sequence_hits(table, spark.createDataFrame([("blast", 50)], "file string, length int")).collect()}
    assert (got["t1.A"].lmatch, got["t1.A"].tmatch, got["t1.A"].source_seq, got["t1.A"].target_seq, got["t1.A"].coverage) == (30, 40, "ACDEFG", "AC-EFG", 0.6)
    assert got["t2.B"].evalue == 2e-3


def test_dihedral_and_angles(spark):
    rows = [((1.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 1.0), (1.0, 0.0, 1.0), 0.0), ((1.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 1.0), (-1.0, 0.0, 1.0), math.pi), ((1.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.0, 1.0, 1.0), math.pi / 2)]
    point = "struct<x:double,y:double,z:double>"
    df = spark.createDataFrame(rows, f"a {point}, b {point}, c {point}, d {point}, want double")
    for r in df.select("want", V.dihedral(*map(V.vec, "abcd")).alias("t"), V.cos_angle(V.vec("a"), V.vec("b"), V.vec("c")).alias("cos")).collect():
        assert abs(r.t) == pytest.approx(r.want, abs=1e-12) and r.cos == pytest.approx(0, abs=1e-12)


def test_radius_join_equals_all_pairs(spark):
    rng = np.random.default_rng(0)
    points = [(k, k % 3, *map(float, rng.uniform(-2, 2, 3))) for k in range(150)]
    df = spark.createDataFrame(points, "id int, g int, x double, y double, z double")
    got = {(r.id, r.o_id) for r in spatial.radius_join(df, df, 0.7, ["g"]).collect()}
    want = {(a[0], b[0]) for a in points for b in points if a[1] == b[1] and math.dist(a[2:], b[2:]) <= 0.7}
    assert got == want


def brute_ring(p, ring):
    ring = np.array(ring, float)
    n = np.cross(ring[1] - ring[0], ring[-1] - ring[0])
    n /= np.linalg.norm(n)
    o = p + n.dot(ring[0] - p) * n
    total = 0.0
    for a, b in zip(ring, np.roll(ring, -1, 0)):
        area = np.cross(a - o, b - o).dot(n) / 2
        total += area * (1 / np.linalg.norm(a - p) ** 3 + 1 / np.linalg.norm(b - p) ** 3)
    return total


def test_ring_current_signs_and_values(spark):
    ring = [(math.cos(k * math.pi / 3), math.sin(k * math.pi / 3), 0.0) for k in range(6)]
    probes = [(1, 0.0, 0.0, 2.0), (2, 4.0, 0.0, 0.0), (3, 0.3, -1.7, 1.0)]
    atoms = spark.createDataFrame([("f", *p) for p in probes], "f string, id int, x double, y double, z double")
    rings = spark.createDataFrame([("f", ring)], "f string, ring array<struct<x:double,y:double,z:double>>")
    got = {r.id: r.ring for r in spatial.ring_current(atoms, rings, ["f"], ["id"], F.lit(1.0), F.lit(1.0)).collect()}
    for i, *p in probes:
        assert got[i] == pytest.approx(brute_ring(np.array(p), ring))
    assert got[1] > 0 > got[2]


def test_features_of_a_peptide(spark, atoms):
    scores = spark.createDataFrame([(a, b, 4.0 if a == b else -1.0) for a in ("ALA", "PHE", "PRO") for b in ("ALA", "PHE", "PRO")], "a string, b string, score double")
    one = features.single(structure.first_model(atoms), scores, flank=2)
    rows = {r.res_num: r for r in one.collect()}
    assert sorted(rows) == [1, 2, 3]
    assert rows[1].PHI_COS == 0 and rows[1].PSI_COS != 0 and rows[3].PSI_COS == 0
    assert rows[2].CHI1_EXISTS == 1 and rows[1].CHI1_EXISTS == 0
    assert rows[2].AVG_B == pytest.approx((20 * 7 + 6) / 13) and rows[1].RESNAME_p1 == "PHE" and rows[1].RESNAME_m1 == "NONE"
    assert rows[1].BLOSUM_ALA == 4.0 and not rows[1].CYS_OX and rows[1].H_RC != 0
    coil = spark.createDataFrame([(c, a, r, v) for c, v in (("ala", 1.0), ("pro", 2.0)) for a in ("H", "HA", "C", "CA", "CB", "N") for r in ("ALA", "PHE", "PRO")], "context string, atom string, resname string, value double")
    three = {r.res_num: r for r in features.preprocess(features.triple(one, coil)).collect()}
    assert three[2].RESNAME_im1 == "ALA" and three[1].RESNAME_im1 == "" and three[2].RCOIL_CA == 2.0 and three[1].RCOIL_CA == 1.0
    assert three[1].AVG_B_im1 == 0 and three[2].AVG_B_im1 == rows[1].AVG_B and three[1].HYDROPHOBICITY == 0.33


def bond_atoms(spark, o_at, mate=None):
    rows = [(1, "ALA", "N", "N", 0.0, 0.0, 0.0), (1, "ALA", "H", "H", 1.0, 0.0, 0.0), (9, "GLY", "O", "O", *o_at)]
    rows += [(9, "GLY", "C", "C", *mate)] if mate else []
    return spark.createDataFrame([("f", 1, "A", n, "", r, a, e, x, y, z, k) for k, (n, r, a, e, x, y, z) in enumerate(rows)], "file_id string, model int, chain string, res_num int, icode string, resname string, atom_name string, element string, x double, y double, z double, pos int")


def test_hydrogen_bond(spark):
    straight = residue.hydrogen_bonds(bond_atoms(spark, (3.0, 0.0, 0.0), (4.2, 0.0, 0.0)))
    row = {r.res_num: r for r in straight.collect()}[1]
    energy = 0.084 * 332 * (1 / 3 + 1 / 3.2 - 1 / 2 - 1 / 4.2)
    assert (row.HN_d, row.HN_EXISTS) == (2.0, 1.0) and row.HN_COS_H == pytest.approx(-1) and row.HN_ENERGY == pytest.approx(energy)
    bent = residue.hydrogen_bonds(bond_atoms(spark, (0.0, 2.0, 0.0), (0.0, 3.0, 0.0)))
    assert {r.res_num: r.HN_EXISTS for r in bent.collect()}[1] == 0
    alone = {r.res_num: r for r in residue.hydrogen_bonds(bond_atoms(spark, (3.0, 0.0, 0.0))).collect()}[1]
    assert alone.HN_COS_A == pytest.approx(math.cos(math.radians(109.5))) and alone.HN_ENERGY == 0 and alone.HN_EXISTS == 1


ATOM_ROW = "file_id string, model int, chain string, res_num int, icode string, resname string, atom_name string, element string, x double, y double, z double, pos int"
#: An alpha hydrogen that points at the O of another residue, whose C is behind it; and an amide H that points at that O.
ALPHA = [(5, "ALA", "CA", "C", 0.0, 0.0, 0.0), (5, "ALA", "HA", "H", 1.0, 0.0, 0.0)]
CARBONYL = [(9, "GLY", "O", "O", 3.0, 0.0, 0.0), (9, "GLY", "C", "C", 4.2, 0.0, 0.0)]
AMIDE = [(20, "SER", "H", "H", 3.0, 1.9, 0.0), (20, "SER", "N", "N", 3.0, 2.9, 0.0)]


def alpha_bond(spark, rows, **options):
    table = spark.createDataFrame([("f", 1, "A", n, "", x, a, e, *p, k) for k, (n, x, a, e, *p) in enumerate(rows)], ATOM_ROW)
    return {r.res_num: r for r in residue.hydrogen_bonds(table, **options).collect()}[5]


def test_alpha_bond_needs_an_acceptor_with_a_bond_of_its_own(spark):
    energy = 0.084 * 332 * (1 / 3 + 1 / 3.2 - 1 / 2 - 1 / 4.2)
    lonely = alpha_bond(spark, ALPHA + CARBONYL)
    assert (lonely.Ha_d, lonely.Ha_EXISTS) == (2.0, 0.0)  # the alpha hydrogen itself is no bond of the O's own
    assert (lonely.Ha_COS_A, lonely.Ha_COS_H, lonely.Ha_ENERGY) == (pytest.approx(-1), pytest.approx(-1), pytest.approx(energy))
    assert alpha_bond(spark, ALPHA + CARBONYL + AMIDE).Ha_EXISTS == 1
    weak = [(20, "SER", "H", "H", 3.0, 4.0, 0.0), (20, "SER", "N", "N", 3.0, 5.0, 0.0)]  # -0.14 kcal/mol
    assert alpha_bond(spark, ALPHA + CARBONYL + weak).Ha_EXISTS == 0
    assert alpha_bond(spark, ALPHA + CARBONYL + weak, energy_of_own=False).Ha_EXISTS == 1
    following = [(10, *x[1:]) for x in AMIDE]  # the O's next residue doesn't count
    assert alpha_bond(spark, ALPHA + CARBONYL + following).Ha_EXISTS == 0
    assert alpha_bond(spark, ALPHA + CARBONYL, restrict_ha=False).Ha_EXISTS == 1


def test_alpha_bond_asks_the_side_chain_oxygen_itself(spark):
    side = [(9, "ASP", "OD1", "O", 3.0, 0.0, 0.0), (9, "ASP", "C", "C", 4.2, 0.0, 0.0)]
    backbone = [(9, "ASP", "O", "O", 6.0, 0.0, 0.0)]
    to_backbone = [(20, "SER", "H", "H", 6.0, 1.9, 0.0), (20, "SER", "N", "N", 6.0, 2.9, 0.0)]
    assert alpha_bond(spark, ALPHA + side + backbone).Ha_EXISTS == 0
    # the backbone's O is bonded, but it isn't the acceptor
    far = [(9, "ASP", "O", "O", 9.4, 0.0, 0.0)]
    bound = [(20, "SER", "H", "H", 11.3, 0.0, 0.0), (20, "SER", "N", "N", 12.3, 0.0, 0.0)]
    assert alpha_bond(spark, ALPHA + side + far + bound).Ha_EXISTS == 0
    # the acceptor is bonded, and there is no backbone O at all
    assert alpha_bond(spark, ALPHA + side + AMIDE).Ha_EXISTS == 1
    assert alpha_bond(spark, ALPHA + side + backbone + to_backbone + AMIDE).Ha_EXISTS == 1
    # two oxygens of one residue: the nearer one is asked
    assert alpha_bond(spark, ALPHA + side + [(9, "ASP", "OD2", "O", 3.2, -0.2, 0.0)] + AMIDE).Ha_d == 2.0


def test_alpha_bond_passes_over_neighbours_and_bent_acceptors(spark):
    for near in (4, 6):
        rows = [(near, *x[1:]) for x in CARBONYL]
        assert alpha_bond(spark, ALPHA + rows + AMIDE).Ha_d == 0
    bent = [(9, "GLY", "O", "O", 1.0, 1.5, 0.0), (9, "GLY", "C", "C", 0.0, 0.9, 0.0)]  # 90 degrees at HA, under 90 at the O
    far = [(12, x[1], x[2], x[3], x[4] + 0.5, *x[5:]) for x in CARBONYL]
    assert alpha_bond(spark, ALPHA + bent + far).Ha_d == 2.5
    # the angle at the O is to its residue's C, not to the nearest heavy atom
    beside = [(9, "GLY", "N", "N", 3.0, -1.1, 0.0)]
    assert alpha_bond(spark, ALPHA + CARBONYL + beside).Ha_COS_A == pytest.approx(-1)


def test_alpha_bond_to_water(spark):
    water = alpha_bond(spark, ALPHA + [(99, "HOH", "O", "O", 3.0, 0.0, 0.0)])
    assert (water.Ha_d, water.Ha_EXISTS, water.Ha_ENERGY) == (2.0, 1.0, 0.0) and water.Ha_COS_A == pytest.approx(math.cos(math.radians(109.5)))


def test_amide_bond_to_nitrogen_and_energy(spark):
    donor, acceptor = [(5, "ALA", "N", "N", 0.0, 0.0, 0.0), (5, "ALA", "H", "H", 1.0, 0.0, 0.0)], [(9, "HIS", "NE2", "N", 3.0, 0.0, 0.0), (9, "HIS", "CE1", "C", 4.2, 0.0, 0.0)]
    row = alpha_bond(spark, donor + acceptor)
    assert (row.HN_d, row.HN_EXISTS) == (2.0, 1.0)
    assert alpha_bond(spark, donor + [(4, *x[1:]) for x in acceptor]).HN_EXISTS == 0
    distant = [(9, "HIS", "NE2", "N", 5.5, 0.0, 0.0), (9, "HIS", "CE1", "C", 6.7, 0.0, 0.0)]
    assert alpha_bond(spark, donor + distant).HN_EXISTS == 1 and alpha_bond(spark, donor + distant, by_energy=True).HN_EXISTS == 0


def test_water_reaches_the_features_and_ph_is_joined(spark, tmp_path):
    rows = [atom(k, n, "ALA", "A", 5, *p, element=e) for k, (n, e, p) in enumerate((("N", "N", (0, 3, 0)), ("CA", "C", (0, 0, 0)), ("HA", "H", (1, 0, 0)), ("C", "C", (-1.2, 0, 1)), ("O", "O", (-2, 0, 2))))]
    rows.append(atom(9, "O", "HOH", "A", 99, 3, 0, 0, het=True))
    table = structure.atoms(text.numbered_lines(spark, write(tmp_path, "w.pdb", rows)))
    scores = spark.createDataFrame([("ALA", "ALA", 4.0)], "a string, b string, score double")
    ph = spark.createDataFrame([("w", 6.5)], "file_id string, ph double")
    row = features.single(table, scores, ph=ph, in_order=True).collect()[0]
    assert (row.Ha_EXISTS, row.Ha_d, row.PH) == (1.0, 2.0, 6.5)
    assert features.single(table, scores).collect()[0].PH == 5.0
    assert "PH" in features.for_atom(features.single(table, scores), "CA")


def test_order_of_residues_is_checked(spark, tmp_path):
    rows = [atom(1, "CA", "ALA", "A", 5, 0, 0, 0), atom(2, "CA", "ALA", "A", 4, 4, 0, 0)]
    table = structure.atoms(text.numbered_lines(spark, write(tmp_path, "u.pdb", rows)))
    scores = spark.createDataFrame([("ALA", "ALA", 4.0)], "a string, b string, score double")
    assert features.single(table, scores).count() == 2
    with pytest.raises(Exception, match="out of order"):
        features.single(table, scores, in_order=True).collect()


def test_ring_current_prefers_the_plain_name(spark, atoms):
    one = structure.first_model(atoms)
    moved = one.filter("atom_name = 'H'").withColumns({"atom_name": F.lit("1H"), "x": F.col("x") + 3, "pos": F.col("pos") + 1000})
    want = {r.res_num: r.H_RC for r in residue.ring_currents(one).collect()}
    assert {r.res_num: r.H_RC for r in residue.ring_currents(one.unionByName(moved)).collect()} == pytest.approx(want)
    alone = {r.res_num: r.H_RC for r in residue.ring_currents(one.filter("atom_name <> 'H'").unionByName(moved)).collect()}
    assert all(alone[k] is not None and alone[k] != want[k] for k in want)


def test_labels_by_alignment(spark):
    columns = list(zip("ACD-EFG", "ACDKE-G"))
    table = spark.createDataFrame([("f", k, a, b) for k, (a, b) in enumerate(columns)], "f string, pos int, feature_res string, label_res string")
    from residuum.operators import transfer

    got = {(r.feature_no, r.label_no) for r in transfer.labels_by_alignment(table, ["f"]).collect()}
    assert got == {(1, 1), (2, 2)}  # the others have a neighbour that differs


def brute_align(a, b, score, go, ge):
    """Best score of a global alignment by recursion over states."""
    from functools import lru_cache

    @lru_cache(None)
    def best(i, j, state):
        if i == len(a) and j == len(b):
            return 0.0
        out = []
        if i < len(a) and j < len(b):
            out.append(score(a[i], b[j]) + best(i + 1, j + 1, 0))
        if i < len(a):
            out.append((ge if state == 1 else go) + best(i + 1, j, 1))
        if j < len(b):
            out.append((ge if state == 2 else go) + best(i, j + 1, 2))
        return max(out)

    return best(0, 0, 0)


def test_alignment_is_optimal():
    rng = np.random.default_rng(3)
    letters, table = "ACDE", np.full((5, 5), -1.0)
    np.fill_diagonal(table, 4.0)
    for _ in range(60):
        a, b = ("".join(rng.choice(list("ACDE"), rng.integers(0, 9))) for _ in range(2))
        x, y, s = search.align(a, b, table, letters, -5.0, -0.5)
        assert x.replace("-", "") == a and y.replace("-", "") == b and len(x) == len(y)
        assert s == pytest.approx(brute_align(a, b, lambda p, q: 4.0 if p == q else -1.0, -5.0, -0.5))


def test_superposition():
    rng = np.random.default_rng(1)
    p = rng.normal(size=(30, 3))
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    assert search.superpose(p, p @ turn + 5) == pytest.approx(0, abs=1e-6)
    assert search.tm_score(p, p @ turn + 5, 30) == pytest.approx(1)
    assert search.superpose(p, p * [1, 1, -1]) > 0.1


def test_sequence_search_ranks_by_alignment(spark):
    rng = np.random.default_rng(5)
    table = np.full((5, 5), -1.0)
    np.fill_diagonal(table, 4.0)
    own = [(k, "".join(rng.choice(list("ACDE"), 30))) for k in range(4)] + [(9, None), (10, "AC")]
    other = []
    for k in range(40):
        chars = list(own[k % 4][1])
        for at in rng.integers(0, 30, k % 7):
            chars[at] = "ACDE"[rng.integers(4)]
        other.append((k, "".join(chars[k % 5 :])))
    other += [(50, None), (51, ""), (52, other[3][1])]
    found = search.sequence_search(spark.createDataFrame(own, "query int, sequence string"), spark.createDataFrame(other, "target int, sequence string"), 4, table.tolist(), "ACDE", least=3, gap_open=-5.0)
    got = {(r.query, r.target): (r.shared, r.aligned.score, r["rank"]) for r in found.collect()}
    words = lambda text: {text[k : k + 4] for k in range(len(text or "") - 3)}
    want = {}
    for q, a in own:
        near = [(-search.align(a, b, table, "ACDE", -5.0, -0.5)[2], t, len(words(a) & words(b))) for t, b in other if len(words(a) & words(b)) >= 3]
        want |= {(q, t): (n, -s, place + 1) for place, (s, t, n) in enumerate(sorted(near))}
    assert got == want and len(want) > 40


def test_one_chain_and_written_files(spark, tmp_path):
    lines = [atom(1, "N", "ALA", "A", 1, 0, 0, 0), atom(2, "CA", "ALA", "A", 1, 1, 0, 0)]
    single = structure.atoms(text.numbered_lines(spark, write(tmp_path, "one.pdb", lines)))
    assert structure.one_chain(single).count() == 2
    both = structure.atoms(text.numbered_lines(spark, write(tmp_path, "two.pdb", [*lines, atom(3, "N", "GLY", "B", 1, 2, 0, 0)])))
    with pytest.raises(Exception, match="several chains"):
        structure.one_chain(both).collect()
    structure.write(both, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out")).select("value").collect()
    assert sorted(r.value for r in back) == sorted(r.line for r in structure.as_lines(both).collect()) and len(back) == 3


def test_numbers_too_wide_for_a_record_come_back(spark):
    numbers = [-999, 0, 9_999, 10_000, 10_000 + 26 * 36**3 - 1, 10_000 + 26 * 36**3, 10_000 + 52 * 36**3 - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    told = df.select("n", L.hybrid36(F.col("n"), 4).alias("t")).select("n", "t", L.from_hybrid36(F.trim("t"), 4).alias("back")).collect()
    assert [(r.n, len(r.t)) for r in told] == [(r.back, 4) for r in told]
    assert [r.t for r in told] == ["-999", "   0", "9999", "A000", "ZZZZ", "a000", "zzzz"]
    assert df.select(L.hybrid36(F.lit(10_000 + 52 * 36**3), 4).alias("t")).first().t is None


def test_files_of_more_atoms_than_a_serial_has_digits(spark):
    rows = spark.range(100_003).select(F.lit("f").alias("file_id"), F.lit(1).alias("model"), F.lit("A").alias("chain"), F.lit("").alias("icode"), F.lit("").alias("altloc"), (F.col("id") / 9).cast("int").alias("res_num"), F.lit(False).alias("het"), F.lit("GLY").alias("resname"), F.concat(F.lit("C"), (F.col("id") % 9).cast("string")).alias("atom_name"), F.lit("C").alias("element"), *[(F.col("id") % 1000).cast("double").alias(c) for c in "xyz"], F.lit(5.0).alias("bfactor"), F.col("id").alias("pos"))
    back = structure.atoms(structure.as_lines(rows).withColumnRenamed("file_id", "file"))
    last = back.filter("pos >= 99999").orderBy("pos").select("pos", "res_num", "resname", "atom_name", "x").collect()
    assert [tuple(r) for r in last] == [(n + 1, n // 9, "GLY", f"C{n % 9}", float(n % 1000)) for n in range(99_998, 100_003)]
    with pytest.raises(Exception, match="too wide"):
        structure.as_lines(rows.limit(1).withColumn("z", F.lit(10_000.0))).collect()


@pytest.mark.parametrize("n", [1, 2])
def test_nearest_equals_all_pairs_without_making_them(spark, monkeypatch, n):
    rng = np.random.default_rng(2)
    places = np.concatenate([rng.normal(0, 0.01, (300, 3)), rng.uniform(-1, 1, (100, 3)), np.zeros((3, 3))])
    points = [(k, k % 3, *map(float, p)) for k, p in enumerate(places)]
    df = spark.createDataFrame(points, "id int, g int, x double, y double, z double").cache()
    radii, join = [], spatial.radius_join
    monkeypatch.setattr(spatial, "radius_join", lambda left, right, radius, *rest: radii.append((radius, left.count())) or join(left, right, radius, *rest))
    got = {r.id: (r.o_id, r.dist) for r in spatial.nearest(df, df, 0.5, ["id"], ["o_id"], n, F.expr("g <> o_g")).collect()}
    want = {}
    for a in points:
        near = sorted((math.dist(a[2:], b[2:]), b[0]) for b in points if a[1] != b[1] and math.dist(a[2:], b[2:]) <= 0.5)
        if len(near) >= n:
            want[a[0]] = near[n - 1]
    assert got == {k: (b, pytest.approx(d)) for k, (d, b) in want.items()}
    assert radii[0][0] < 0.5 and radii[-1] < (0.51, 150)


def test_ring_currents_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "TARGETS", 3)
    monkeypatch.setattr(spatial, "CORNERS", 7)
    rng = np.random.default_rng(4)
    rings = [[tuple(map(float, p)) for p in rng.normal(0, 5, (5, 3))] for _ in range(6)]
    probes = [tuple(map(float, p)) for p in rng.normal(0, 5, (12, 3))] + [rings[0][2]]
    flat = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (2.0, 0.0, 0.0)]
    point = "struct<x:double,y:double,z:double>"
    atoms = spark.createDataFrame([("f", k, *p) for k, p in enumerate(probes)] + [("g", 50, 0.0, 0.0, 1.0), ("h", 60, 0.0, 0.0, 1.0)], "f string, id int, x double, y double, z double")
    table = spark.createDataFrame([("f", r, float(k)) for k, r in enumerate(rings)] + [("f", flat, 9.0), ("g", flat, 9.0)], f"f string, ring array<{point}>, i double")
    got = {r.id: r.ring for r in spatial.ring_current(atoms, table, ["f"], ["id"], F.col("i"), F.col("id") + 1).collect()}
    assert set(got) == {*range(13), 50} and got[50] is None
    for k, p in enumerate(probes[:-1]):
        assert got[k] == pytest.approx((k + 1) * sum(i * brute_ring(np.array(p), r) for i, r in enumerate(rings)))
    assert got[12] == pytest.approx(13 * sum(i * brute_ring(np.array(probes[-1]), r) for i, r in enumerate(rings) if i))


def test_exploded_rows_are_not_broadcast(spark):
    df = spark.range(4).select(F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit("t").alias("target"))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(spatial.radius_join(df, df, 1.0))
    rows = spark.createDataFrame([("q", "t", 1, "A", "A")], "query string, target string, pos int, source_res string, target_res string")
    labels_ = spark.range(9).select(F.lit("t").alias("target"), (F.col("id") + 1).alias("ordinal"), F.lit("CA").alias("atom"), F.lit(1.0).alias("value"))
    same = spark.createDataFrame([("A", "A", 1.0)], "a string, b string, score double")
    found = transfer.transfer_labels(rows, labels_, same)
    assert found.count() == 1 and "SortMergeJoin [target" in plan(found)


def test_pairs_of_letters_are_the_side_that_is_broadcast(spark):
    rows = spark.range(50).select(F.lit("q").alias("query"), F.col("id").cast("string").alias("target"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("pos"), F.lit("A").alias("source_res"), F.lit("P").alias("target_res"))
    labels_ = spark.range(50).select(F.col("id").cast("string").alias("target"), F.lit(1).cast("long").alias("ordinal"), F.lit("CA").alias("atom"), F.lit(1.0).alias("value"))
    similar = spark.createDataFrame([("A", "P", 1.0), ("P", "A", -1.0)], "a string, b string, score double")
    coil = spark.createDataFrame([("pro", "CA", "P", 0.25)], "context string, atom string, resname string, value double")
    found = transfer.transfer_labels(rows, labels_, similar, 1, coil)
    assert [r.value for r in found.collect()] == [0.75] * 50
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BuildRight") >= 2 and "BuildLeft" not in plan
