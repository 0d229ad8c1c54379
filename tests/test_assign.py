"""Secondary structure and surface from coordinates: an ideal helix, areas by formula, a far residue."""

import math

import pytest
from pyspark.sql import functions as F

from residuum.operators import assign, residue
from residuum.plans import structures
from residuum.plans.structures import _HELIX

ROW = "file_id string, model int, chain string, res_num int, resname string, atom_name string, element string, x double, y double, z double, pos int"


def helix(n, chain="A", first=1, shift=0.0, proline=()):
    rows = []
    for k in range(n):
        for a, (r, angle, z) in _HELIX.items():
            t = math.radians(99.473 * k + angle)
            rows.append(("f", 1, chain, first + k, "PRO" if k in proline else "ALA", a, a[0], shift + r * math.cos(t), r * math.sin(t), 1.5514 * k + z))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], ROW)


def letters(df):
    return "".join(r.ss for r in df.orderBy("chain", "res_num").collect())


def test_a_helix_is_a_helix(spark):
    # NH of the first four residues and CO of the last four have no partner
    assert letters(assign.secondary(table(spark, helix(12)))) == "-HHHHHHHHHH-"
    # a gap in the numbers alone is no break, one in space is; five residues have a single turn, which is no helix
    moved = [(*r[:3], r[3] + 40, *r[4:]) for r in helix(12) if r[3] > 6] + [r for r in helix(12) if r[3] <= 6]
    assert letters(assign.secondary(table(spark, moved))) == "-HHHHHHHHHH-"
    apart = helix(6) + helix(5, first=7, shift=60.0)
    assert letters(assign.secondary(table(spark, apart))) == "-HHHH--TTT-"
    # a chain that goes on elsewhere is none of the first one's
    assert letters(assign.secondary(table(spark, helix(6) + helix(6, chain="B", shift=60.0)))) == "-HHHH-" * 2


def test_residues_without_a_backbone_or_h(spark):
    rows = [r for r in helix(12) if not (r[3] == 6 and r[5] == "O")]
    got = assign.secondary(table(spark, rows))
    assert got.count() == 11 and got.filter("res_num = 6").count() == 0
    bonds = assign.backbone_bonds(assign.backbone(table(spark, helix(12, proline=[7]))))
    assert {r.nh - r.co for r in bonds.filter("energy < -1").collect()} == {4} and bonds.filter("nh = co + 4").count() == 7  # eight, but for the proline's
    assert assign.secondary(table(spark, helix(12)).limit(0)).count() == 0


def test_surface_of_spheres(spark):
    area = lambda r: 4 * math.pi * (r + 1.4) ** 2
    far = [("f", 1, "A", 1, "GLY", "CA", "C", 0.0, 0.0, 0.0), ("f", 1, "A", 2, "GLY", "N", "N", 50.0, 0.0, 0.0), ("f", 1, "A", 2, "GLY", "H", "H", 50.5, 0.0, 0.0)]
    got = {r.res_num: r.asa for r in assign.surface(table(spark, far)).collect()}
    assert got == {1: pytest.approx(area(1.7)), 2: pytest.approx(area(1.55))}
    # two spheres that meet: the cap beyond the plane between them is lost, 2 pi R h
    d = 3.0
    two = [("f", 1, "A", k, "GLY", "CA", "C", k * d, 0.0, 0.0) for k in (0, 1)]
    cap = 2 * math.pi * 3.1 * (3.1 - d / 2)
    got = [r.asa for r in assign.surface(table(spark, two), 960).collect()]
    assert got == [pytest.approx(area(1.7) - cap, rel=0.01)] * 2
    inside = [("f", 1, "A", 1, "GLY", "C", "C", 0.0, 0.0, 0.0)] + [("f", 1, "A", 2, "GLY", f"C{k}", "C", *(1.2 * c for c in p)) for k, p in enumerate([(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)])]
    assert {r.res_num: r.asa for r in assign.surface(table(spark, inside), 200).collect()}[1] < 0.15 * area(1.7)


def test_assignment_feeds_the_features(spark):
    got = residue.accessible(assign.assigned(table(spark, helix(12)))).orderBy("res_num").collect()
    assert [r.H_SS for r in got] == [0, *[1] * 10, 0] and all(0 < r.rel_asa < 3 and r.ABS_ASA > 0 for r in got)
    assert assign.assigned(table(spark, helix(12)).withColumn("extra", F.lit(1))).columns == [*residue.KEY, "resname", "ss", "rel_asa"]


def test_long_chains_are_counted_in_stretches(spark, monkeypatch):
    # a chain of one stretch and more, a break at a border and one within, a second chain, a missing number, a negative one
    rows = [r for r in helix(40, first=-7) if r[3] != 11] + helix(9, first=40, shift=60.0) + helix(6, first=51, shift=90.0) + helix(12, chain="B", shift=-60.0)
    whole = assign.backbone(table(spark, rows)).orderBy("chain", "res_num").collect()
    assert [r["at"] for r in whole][:20] == [*range(10, 28), 37, 38] and len(whole) == 66
    for stretch in (1, 3):
        monkeypatch.setattr(assign, "STRETCH", stretch)
        assert assign.backbone(table(spark, rows)).orderBy("chain", "res_num").collect() == whole


def test_no_window_takes_a_whole_file(spark):
    t = spark.range(4000).selectExpr("id AS vec_id", "transform(sequence(0, 63), k -> CAST(0.1 AS FLOAT)) AS embedding", "CAST(id % 3 AS INT) AS label")
    for df in (structures._folded(lambda _: t), structures._everything(lambda _: t)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        # rows with vectors go by label and stretch; counts alone go by label
        assert "row_number() windowspecdefinition(label#" in plan
        assert all("__block" in line for line in plan.splitlines() if "row_number()" in line)
