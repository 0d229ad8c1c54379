"""Queries on structures, reports and label files. Atoms come from the embeddings table: each vector is a residue on a grid, its
triples of numbers are the places of its atoms; every tenth also has a water. Text files are made of tables, line by line, and parsed."""

from __future__ import annotations

from pyspark.sql import functions as F

from residuum.functions import lookup
from residuum.operators import assign, evaluate, residue, search, structure_search, transfer
from residuum.operators import windows as W
from residuum.plans import features
from residuum.plans.registry import query
from residuum.session import stash
from residuum.sources import labels, reports, structure, text

NAMES = sorted(lookup.HYDROPHOBICITY)
ATOMS = "N CA C O CB H HA CG CD1 CD2 CE1 CE2 CZ SG CD ND1 NE2 OG CE3 OD1 CZ2".split()
LETTERS = "ARNDCQEGHILKMFPSTWYV"


def _listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


_PLACE = "3 * (rn % 8) + 8 * CAST(e[{0}] AS DOUBLE) AS x, 3 * ((rn // 8) % 8) + 8 * CAST(e[{1}] AS DOUBLE) AS y, 3 * (rn // 64) + 8 * CAST(e[{2}] AS DOUBLE) AS z"
_ATOMS = f"""base AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn, embedding AS e FROM embeddings),
everything AS (
  SELECT 'f' || label AS file_id, CAST(rn + CASE WHEN rn >= 20 THEN 3 ELSE 0 END AS INTEGER) AS res_num, false AS het, ({_listed(NAMES)})[vec_id % 20 + 1] AS resname, ({_listed(ATOMS)})[k + 1] AS atom_name,
         ({_listed(a[0] for a in ATOMS)})[k + 1] AS element, {_PLACE.format("3 * k + 1", "3 * k + 2", "3 * k + 3")}, CAST(10 + (vec_id * 7 + k) % 50 AS DOUBLE) AS bfactor, vec_id * 32 + k AS pos
  FROM base, (SELECT unnest(range(21)) AS k)
  UNION ALL SELECT 'f' || label, CAST(900 + rn AS INTEGER), true, 'HOH', 'O', 'O', {_PLACE.format(62, 63, 64)}, 5, vec_id * 32 + 31 FROM base WHERE rn % 10 = 0),
atoms AS (SELECT * FROM everything WHERE NOT het)"""


def _numbered(t):
    """Embeddings with their number within the label, from 0; labels are few and may be long, so stretches of ids are numbered alone."""
    return W.line_numbers(t("embeddings"), ["label"], "vec_id", "rn", 20_000).withColumn("rn", (F.col("rn") - 1).cast("int"))


def _everything(t):
    """Atoms of all files, water included."""
    rows = _numbered(t)
    row, at = F.col("rn"), lambda k, n: F.get("embedding", k).cast("double") * 8 + n
    shift = (3 * (row % 8), 3 * (F.floor(row / 8) % 8), 3 * F.floor(row / 64))

    def atom(k, name, element, number, resname, het, first, bfactor, pos):
        place = [at(first + i, n).alias(c) for i, (n, c) in enumerate(zip(shift, "xyz"))]
        return F.struct(number.cast("int").alias("res_num"), F.lit(het).alias("het"), resname.alias("resname"), name.alias("atom_name"), element.alias("element"), *place, bfactor.cast("double").alias("bfactor"), pos.alias("pos"))

    pick = lambda values, k: F.get(F.array(*[F.lit(v) for v in values]), k)
    own = lambda k: atom(k, pick(ATOMS, k), pick([a[0] for a in ATOMS], k), row + F.when(row >= 20, 3).otherwise(0), pick(NAMES, (F.col("vec_id") % 20).cast("int")), False, 3 * k, 10 + (F.col("vec_id") * 7 + k) % 50, F.col("vec_id") * 32 + k)
    water = atom(0, F.lit("O"), F.lit("O"), 900 + row, F.lit("HOH"), True, F.lit(61), F.lit(5), F.col("vec_id") * 32 + 31)
    all_ = F.concat(F.transform(F.sequence(F.lit(0), F.lit(len(ATOMS) - 1)), own), F.when(row % 10 == 0, F.array(water)).otherwise(F.array().cast(rows.select(F.array(water)).schema[0].dataType)))
    rows = rows.select(F.concat(F.lit("f"), F.col("label").cast("string")).alias("file_id"), F.lit(1).alias("model"), F.lit("A").alias("chain"), F.lit("").alias("icode"), F.lit("").alias("altloc"), F.inline(all_))
    return rows


def _atoms(t):
    return _everything(t).filter("NOT het")


def _rounded(df, names, digits=6):
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) + 0.0 for n in names})  # no negative zero


# vectors as SQL: triples of expressions


def _v(name):
    return tuple(f"{name}_{c}" for c in "xyz")


def _sub(a, b):
    return tuple(f"({p} - {q})" for p, q in zip(a, b))


def _dot(a, b):
    return "(" + " + ".join(f"{p} * {q}" for p, q in zip(a, b)) + ")"


def _cross(a, b):
    return tuple(f"({a[i]} * {b[j]} - {a[j]} * {b[i]})" for i, j in ((1, 2), (2, 0), (0, 1)))


def _far(a, b):
    return f"sqrt({_dot(_sub(a, b), _sub(a, b))})"


def _cosine(a, at, b):
    u, v = _sub(a, at), _sub(b, at)
    return f"greatest(-1e0, least(1e0, {_dot(u, v)} / (sqrt({_dot(u, u)}) * sqrt({_dot(v, v)}))))"


def _torsion(a, b, c, d):
    u, v, w = _sub(b, a), _sub(c, b), _sub(d, c)
    n, m = _cross(u, v), _cross(v, w)
    return f"atan2(sqrt({_dot(v, v)}) * {_dot(u, m)}, {_dot(n, m)})"


def _named(names):
    return ", ".join(f"max({c}) FILTER (atom_name = '{n}') AS {n.lower()}_{c}" for n in names for c in "xyz")


def _places(names):
    return f"placed AS (SELECT file_id, res_num, resname, {_named(names)} FROM atoms GROUP BY ALL)"


@query(f"""WITH {_ATOMS}, {_places(["N", "CA", "C"])},
m AS (SELECT *, {", ".join(f"lag(c_{c}) OVER w AS b_{c}, lead(n_{c}) OVER w AS d_{c}" for c in "xyz")} FROM placed WINDOW w AS (PARTITION BY file_id ORDER BY res_num)),
a AS (SELECT file_id, res_num, CASE WHEN {_far(_v("b"), _v("n"))} <= 2.1 THEN {_torsion(_v("b"), _v("n"), _v("ca"), _v("c"))} END AS phi,
      CASE WHEN {_far(_v("c"), _v("d"))} <= 2.1 THEN {_torsion(_v("n"), _v("ca"), _v("c"), _v("d"))} END AS psi FROM m)
SELECT file_id, res_num, {", ".join(f'round(coalesce({f}({p}), 0), 6) + 0e0 AS "{p.upper()}_{f.upper()}"' for p in ("phi", "psi") for f in ("cos", "sin"))} FROM a""")
def residue_torsions(t):
    return _rounded(residue.torsions(_atoms(t)).drop("model", "chain"), ["PHI_COS", "PHI_SIN", "PSI_COS", "PSI_SIN"])


_CHIS = [(res, chi, *("N", "CA", "CB", *side)[chi - 1 : chi + 3]) for res, side in lookup.SIDE_CHAINS.items() for chi in range(1, len(side) + 1) if chi <= 3]


@query(f"""WITH {_ATOMS}, defs(resname, chi, p, q, r, s) AS (VALUES {", ".join(map(str, _CHIS))}),
placed AS (SELECT DISTINCT file_id, res_num, resname FROM atoms),
four AS (SELECT l.file_id, l.res_num, chi, {", ".join(f"{k}.{c} AS {k}_{c}" for k in "pqrs" for c in "xyz")} FROM placed l JOIN defs USING (resname)
  {" ".join(f"JOIN atoms {k} ON {k}.file_id = l.file_id AND {k}.res_num = l.res_num AND {k}.atom_name = defs.{k}" for k in "pqrs")}),
t AS (SELECT file_id, res_num, chi, {_torsion(*map(_v, "pqrs"))} AS t FROM four)
SELECT l.file_id, l.res_num, {", ".join(f'round(coalesce(max(cos(t)) FILTER (chi = {k}), 0), 6) + 0e0 AS "CHI{k}_COS", round(coalesce(max(sin(t)) FILTER (chi = {k}), 0), 6) + 0e0 AS "CHI{k}_SIN", count(t) FILTER (chi = {k}) AS "CHI{k}_EXISTS"' for k in (1, 2, 3))}
FROM placed l LEFT JOIN t ON l.file_id = t.file_id AND l.res_num = t.res_num GROUP BY l.file_id, l.res_num""")
def residue_side_torsions(t):
    out = residue.side_torsions(_atoms(t), (1, 2, 3)).drop("model", "chain")
    out = _rounded(out, [f"CHI{k}_{f}" for k in (1, 2, 3) for f in ("COS", "SIN")])
    return out.withColumns({f"CHI{k}_EXISTS": F.col(f"CHI{k}_EXISTS").cast("long") for k in (1, 2, 3)})


def _bond(prefix, base, tip, elements, skip, third=None):
    """CTEs: <prefix>_all, the candidates of a bond with their angles; both angles must be 90 degrees or more to be in <prefix>_ok."""
    a0, a1, a2, a3 = map(_v, ("p", "q", "o", "m"))
    third_on = f"m.atom_name = '{third}'" if third else "m.element IN ('N', 'C', 'O')"
    reach = "" if third else f" AND {_far(('m.x', 'm.y', 'm.z'), ('o.x', 'o.y', 'o.z'))} > 0.5 AND {_far(('m.x', 'm.y', 'm.z'), ('o.x', 'o.y', 'o.z'))} < 5"
    return f"""{prefix}_pairs AS (
  SELECT a.file_id, a.res_num, {", ".join(f"a.{base}_{c} AS p_{c}, a.{tip}_{c} AS q_{c}, o.{c} AS o_{c}" for c in "xyz")}, o.res_num AS o_res, o.pos AS o_pos
  FROM placed a JOIN everything o ON a.file_id = o.file_id AND o.element IN ({elements}) AND o.res_num <> a.res_num AND o.res_num NOT IN ({", ".join(f"a.res_num + ({k})" for k in skip)})),
{prefix}_near AS (SELECT *, {_far(a1, a2)} AS d FROM {prefix}_pairs WHERE {_far(a1, a2)} > 0.5 AND {_far(a1, a2)} < 5),
{prefix}_third AS (
  SELECT * FROM (SELECT o.file_id, o.pos AS o_pos, m.x AS m_x, m.y AS m_y, m.z AS m_z, row_number() OVER (PARTITION BY o.file_id, o.pos ORDER BY {_far(('m.x', 'm.y', 'm.z'), ('o.x', 'o.y', 'o.z'))}, m.pos) AS k
  FROM everything o JOIN everything m ON o.file_id = m.file_id AND o.res_num = m.res_num AND {third_on}{reach} WHERE o.element IN ({elements})) WHERE k = 1),
{prefix}_all AS (
  SELECT n.*, m_x IS NULL AS alone, {_cosine(a0, a1, a2)} AS cos_h, CASE WHEN m_x IS NULL THEN cos(radians(109.5)) ELSE {_cosine(a1, a2, a3)} END AS cos_a,
         CASE WHEN m_x IS NULL THEN 0e0 ELSE 0.084 * 332 * (1 / {_far(a0, a2)} + 1 / {_far(a1, a3)} - 1 / d - 1 / {_far(a0, a3)}) END AS energy
  FROM {prefix}_near n LEFT JOIN {prefix}_third t ON n.file_id = t.file_id AND n.o_pos = t.o_pos),
{prefix}_ok AS (SELECT *, row_number() OVER (PARTITION BY file_id, res_num ORDER BY d, o_pos) AS k FROM {prefix}_all WHERE cos_h <= 1e-12 AND cos_a <= 1e-12)"""


def _bond_columns(prefix, exists):
    return ", ".join(f'round(coalesce({prefix}.{c}, 0), 5) + 0e0 AS "{n}_{k}"' for n in (prefix,) for k, c in (("d", "d"), ("COS_A", "cos_a"), ("COS_H", "cos_h"), ("ENERGY", "energy"))) + f', CAST({exists} AS DOUBLE) AS "{prefix}_EXISTS"'


_BOND_NAMES = [f"{p}_{n}" for p in ("Ha", "HN", "O") for n in ("d", "COS_A", "COS_H", "ENERGY", "EXISTS")]


@query(f"""WITH {_ATOMS}, {_places(["N", "CA", "C", "O", "H", "HA"])}, {_bond("Ha", "ca", "ha", "'O'", (-1, 1), "C")}, {_bond("HN", "n", "h", "'N', 'O'", (-1,))}, {_bond("O", "c", "o", "'H', 'D'", (1,))},
own AS (
  SELECT h.file_id, h.res_num, count(*) AS n FROM Ha_ok h JOIN Ha_third c ON c.file_id = h.file_id AND c.o_pos = h.o_pos JOIN everything b ON b.file_id = h.file_id AND b.element IN ('H', 'D') AND b.res_num <> h.o_res AND b.res_num <> h.o_res + 1
         AND {_far(_v("h.o"), ("b.x", "b.y", "b.z"))} > 0.5 AND {_far(_v("h.o"), ("b.x", "b.y", "b.z"))} < 5 AND NOT (b.x = h.q_x AND b.y = h.q_y AND b.z = h.q_z)
    LEFT JOIN O_third t ON t.file_id = b.file_id AND t.o_pos = b.pos
  WHERE h.k = 1 AND NOT h.alone AND {_cosine(_v("c.m"), _v("h.o"), ("b.x", "b.y", "b.z"))} <= 1e-12
    AND (t.m_x IS NULL OR {_cosine(_v("h.o"), ("b.x", "b.y", "b.z"), _v("t.m"))} <= 1e-12 AND 0.084 * 332 * (1 / {_far(_v("c.m"), ("b.x", "b.y", "b.z"))} + 1 / {_far(_v("h.o"), _v("t.m"))} - 1 / {_far(_v("h.o"), ("b.x", "b.y", "b.z"))} - 1 / {_far(_v("c.m"), _v("t.m"))}) <= -0.5)
  GROUP BY ALL)
SELECT l.file_id, l.res_num, {_bond_columns("Ha", "coalesce(Ha.alone OR own.n > 0, false)")}, {_bond_columns("HN", "HN.d IS NOT NULL")}, {_bond_columns("O", "O.d IS NOT NULL")}
FROM placed l LEFT JOIN Ha_ok Ha ON l.file_id = Ha.file_id AND l.res_num = Ha.res_num AND Ha.k = 1 LEFT JOIN own ON l.file_id = own.file_id AND l.res_num = own.res_num
LEFT JOIN HN_ok HN ON l.file_id = HN.file_id AND l.res_num = HN.res_num AND HN.k = 1 LEFT JOIN O_ok O ON l.file_id = O.file_id AND l.res_num = O.res_num AND O.k = 1""")
def residue_hydrogen_bonds(t):
    out = residue.hydrogen_bonds(_atoms(t), around=_everything(t))
    return _rounded(out.select("file_id", "res_num", *_BOND_NAMES), _BOND_NAMES, 5)


@query(f"""WITH {_ATOMS}, {_places(["CA", "CB"])},
m AS (SELECT *, {", ".join(f"lag(ca_{c}) OVER w AS b_{c}, lead(ca_{c}) OVER w AS d_{c}" for c in "xyz")} FROM placed WINDOW w AS (PARTITION BY file_id ORDER BY res_num)),
u AS (SELECT *, {", ".join(f"cb_{c} - ca_{c} AS s_{c}, (ca_{c} - b_{c}) / {_far(_v('ca'), _v('b'))} + (ca_{c} - d_{c}) / {_far(_v('ca'), _v('d'))} AS a_{c}" for c in "xyz")} FROM m),
o AS (SELECT file_id, res_num, ca_x AS o_x, ca_y AS o_y, ca_z AS o_z FROM placed),
n AS (SELECT u.file_id, u.res_num, {_dot(_v("u.s"), _sub(_v("o.o"), _v("u.ca")))} AS side, {_dot(_v("u.a"), _sub(_v("o.o"), _v("u.ca")))} AS back
      FROM u JOIN o ON u.file_id = o.file_id AND {_far(_v("u.ca"), _v("o.o"))} <= 12 AND {_far(_v("u.ca"), _v("o.o"))} > 0.1)
SELECT u.file_id, u.res_num, round(coalesce(any_value(acos({_cosine(_v("u.s"), ("0e0",) * 3, _v("u.a"))})), 0), 5) AS "HSE_CA_ANGLE", count(*) FILTER (side > 0) AS "HSE_CB_U", count(*) FILTER (side <= 0) AS "HSE_CB_D",
       count(*) FILTER (back > 0) AS "HSE_CA_U", count(*) FILTER (back <= 0) AS "HSE_CA_D" FROM u LEFT JOIN n ON u.file_id = n.file_id AND u.res_num = n.res_num GROUP BY u.file_id, u.res_num""")
def residue_exposure(t):
    return _rounded(residue.exposure(_atoms(t)).drop("model", "chain"), ["HSE_CA_ANGLE"], 5)


_CORNERS = [(res, no, strength, len(names), k, a) for (res, no), (strength, names) in lookup.RINGS.items() for k, a in enumerate(names)]


@query(f"""WITH {_ATOMS}, defs(resname, ring_no, intensity, corners, k, atom_name) AS (VALUES {", ".join(map(str, _CORNERS))}),
corner AS (SELECT file_id, res_num, ring_no, intensity, corners, k, x, y, z, count(*) OVER (PARTITION BY file_id, res_num, ring_no) AS n FROM atoms JOIN defs USING (resname, atom_name)),
edge AS (SELECT a.file_id, a.res_num AS r, a.ring_no, a.intensity, a.k, a.x AS u_x, a.y AS u_y, a.z AS u_z, b.x AS v_x, b.y AS v_y, b.z AS v_z,
         {", ".join(f"first_value(a.{c}) OVER w AS f_{c}, first_value(b.{c}) OVER w AS s_{c}, last_value(a.{c}) OVER w AS l_{c}" for c in "xyz")}
         FROM corner a JOIN corner b ON a.file_id = b.file_id AND a.res_num = b.res_num AND a.ring_no = b.ring_no AND b.k = (a.k + 1) % a.corners WHERE a.n = a.corners
         WINDOW w AS (PARTITION BY a.file_id, a.res_num, a.ring_no ORDER BY a.k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
plane AS (SELECT *, {", ".join(f"{e} AS c_{c}" for e, c in zip(_cross(_sub(_v("s"), _v("f")), _sub(_v("l"), _v("f"))), "xyz"))} FROM edge),
unit AS (SELECT *, {", ".join(f"c_{c} / sqrt({_dot(_v('c'), _v('c'))}) AS n_{c}" for c in "xyz")} FROM plane),
target AS (SELECT file_id, res_num, atom_name AS a, x AS q_x, y AS q_y, z AS q_z, CASE atom_name WHEN 'HA' THEN 5.13 WHEN 'H' THEN 7.06 WHEN 'CA' THEN 1.5 ELSE 1.0 END AS factor FROM atoms WHERE atom_name IN ('C', 'CA', 'CB', 'N', 'HA', 'H')),
met AS (SELECT t.file_id, t.res_num, a, factor, intensity, {", ".join(f"u_{c}, v_{c}, n_{c}, q_{c}" for c in "xyz")}, {_dot(_sub(_v("q"), _v("f")), _v("n"))} AS h FROM target t JOIN unit e ON t.file_id = e.file_id),
flat AS (SELECT *, {", ".join(f"q_{c} - h * n_{c} AS p_{c}" for c in "xyz")} FROM met),
parts AS (SELECT file_id, res_num, a, intensity * factor * {_dot(_cross(_sub(_v("u"), _v("p")), _sub(_v("v"), _v("p"))), _v("n"))} / 2
          * (CASE WHEN {_far(_v("q"), _v("u"))} > 0 THEN 1 / pow({_far(_v("q"), _v("u"))}, 3) ELSE 0 END + CASE WHEN {_far(_v("q"), _v("v"))} > 0 THEN 1 / pow({_far(_v("q"), _v("v"))}, 3) ELSE 0 END) AS s FROM flat)
SELECT t.file_id, t.res_num, {", ".join(f'round(coalesce(sum(s) FILTER (p.a = {chr(39)}{a}{chr(39)}), 0), 3) + 0e0 AS "{a}_RC"' for a in ("C", "CA", "CB", "N", "HA", "H"))}
FROM (SELECT DISTINCT file_id, res_num FROM target) t LEFT JOIN parts p ON t.file_id = p.file_id AND t.res_num = p.res_num GROUP BY t.file_id, t.res_num""")
def residue_ring_currents(t):
    names = [f"{a}_RC" for a in ("C", "CA", "CB", "N", "HA", "H")]
    return _rounded(residue.ring_currents(_atoms(t)).select("file_id", "res_num", *names), names, 3)


@query(f"""WITH {_ATOMS}, {_places(["O", "H"])},
w AS (SELECT *, CASE WHEN lag(res_num) OVER w = res_num - 1 THEN lag(o_x) OVER w END AS b_x, lag(o_y) OVER w AS b_y, lag(o_z) OVER w AS b_z FROM placed WINDOW w AS (PARTITION BY file_id ORDER BY res_num)),
probe AS (SELECT file_id, res_num, b_x AS p_x, b_y AS p_y, b_z AS p_z FROM w WHERE b_x IS NOT NULL UNION ALL SELECT file_id, res_num, h_x, h_y, h_z FROM w WHERE h_x IS NOT NULL),
near AS (SELECT p.file_id, p.res_num, {_far(_v("p"), ("o.x", "o.y", "o.z"))} AS d FROM probe p JOIN atoms o ON p.file_id = o.file_id AND o.atom_name NOT LIKE '%H%' AND o.res_num NOT IN (p.res_num, p.res_num - 1)),
s AS (SELECT file_id, res_num, sum(exp(1.2 - d)) AS c FROM near WHERE d <= 10 AND d > 0.1 GROUP BY ALL)
SELECT w.file_id, w.res_num, round(tanh(0.8 * coalesce(c, 0)) - 0.1, 6) AS "S2" FROM w LEFT JOIN s ON w.file_id = s.file_id AND w.res_num = s.res_num""")
def residue_contact_order(t):
    return _rounded(residue.contact_order(_atoms(t)).drop("model", "chain"), ["S2"])


@query(f"""WITH {_ATOMS} SELECT file_id, res_num, round(avg(bfactor), 6) AS mean_all, round(sum(bfactor) FILTER (atom_name IN ('N', 'CA', 'C', 'CB', 'HA', 'H')) / 6, 6) AS mean_six FROM atoms GROUP BY file_id, res_num""")
def residue_bfactor(t):
    rows, key = _atoms(t), residue.KEY
    both = residue.mean_bfactor(rows).withColumnRenamed("AVG_B", "mean_all").join(residue.mean_bfactor(rows, six_only=True).withColumnRenamed("AVG_B", "mean_six"), key)
    return _rounded(both.drop("model", "chain"), ["mean_all", "mean_six"])


@query(f"""WITH {_ATOMS}, s AS (SELECT * FROM atoms WHERE atom_name = 'SG'),
p AS (SELECT DISTINCT a.file_id, a.res_num FROM s a JOIN s b ON a.file_id = b.file_id AND abs(a.res_num - b.res_num) >= 4 AND {_far(("a.x", "a.y", "a.z"), ("b.x", "b.y", "b.z"))} <= 2.5)
SELECT l.file_id, l.res_num, p.file_id IS NOT NULL AS "CYS_OX" FROM (SELECT DISTINCT file_id, res_num FROM atoms) l LEFT JOIN p ON l.file_id = p.file_id AND l.res_num = p.res_num""")
def residue_oxidised(t):
    return residue.oxidised(_atoms(t)).drop("model", "chain")


@query(f"""WITH {_ATOMS} SELECT DISTINCT file_id, res_num, {", ".join(f'CAST((list_position({_listed(NAMES)}, resname) - 1) * {k} % 7 - 3 AS DOUBLE) AS "BLOSUM_{n}"' for k, n in enumerate(NAMES))} FROM atoms""")
def residue_substitution_row(t):
    rows = _atoms(t)
    scores = rows.sparkSession.createDataFrame([(a, b, float(i * j % 7 - 3)) for i, a in enumerate(NAMES) for j, b in enumerate(NAMES)], lookup.SUBSTITUTION_SCHEMA)
    return residue.substitution_row(rows, scores).drop("model", "chain")


_SS = "HBEGITS-"


@query(f"""WITH {_ATOMS}, d AS (SELECT DISTINCT file_id, res_num, resname, '{_SS}'[res_num % 8 + 1] AS ss, (res_num % 11) / 10 AS rel_asa FROM atoms)
SELECT file_id, res_num, resname, ss, rel_asa, round(rel_asa * CASE resname {" ".join(f"WHEN '{k}' THEN {v}" for k, v in lookup.MAX_ASA.items())} END, 6) AS "ABS_ASA",
       {", ".join(f"CAST(ss = '{s}' AS INTEGER) AS " + chr(34) + f"{c}_SS" + chr(34) for c, s in zip("HBEGITSx", _SS))} FROM d""")
def residue_accessible(t):
    number = F.col("res_num")
    dssp = _atoms(t).select("file_id", "res_num", "resname").distinct().withColumns({"ss": F.substring(F.lit(_SS), number % 8 + 1, F.lit(1)), "rel_asa": (number % 11) / 10})
    return _rounded(residue.accessible(dssp), ["ABS_ASA"])


#: Backbone atoms on a helix: distance from its axis, angle in degrees and height (fixed by bond lengths and angles, and torsions of -57 and -47 degrees).
_HELIX = {"N": (1.55, 0.0, 0.0), "CA": (2.276, 26.81, 0.917), "C": (1.664, 53.61, 1.984), "O": (1.925, 46.88, 3.168)}
#: And on strands that run to and fro, 12 residues each: along, up (turned by residue) and whether every fifth residue lacks it.
_STRAND = {"N": (-1.2, 0.0), "CA": (0.0, 0.0), "C": (1.2, 0.0), "O": (1.2, 1.23), "H": (-1.2, 1.0)}


def _folded_sql(a, k):
    """Place of an atom of the k-th kind: a helix where the file's number is even, strands where it is odd, with a little of the vector."""
    along, up = _STRAND[a]
    noise = [f"0.3e0 * CAST(e[{3 * k + c}] AS DOUBLE)" for c in (1, 2, 3)]
    j, turn, side = "(rn % 12)", "(CASE WHEN (rn // 12) % 2 = 0 THEN 1e0 ELSE -1e0 END)", "(CASE WHEN rn % 2 = 0 THEN 1e0 ELSE -1e0 END)"
    strand = (f"CASE WHEN (rn // 12) % 2 = 0 THEN 3.4e0 * {j} ELSE 3.4e0 * (11 - {j}) END + {turn} * {along}", f"CASE WHEN (rn // 12) % 2 = 0 THEN 0e0 ELSE 4.9e0 END + {side} * {up}", "10e0 * (rn // 24)")
    if a == "H":
        helix = strand
    else:
        r, angle, z = _HELIX[a]
        helix = (f"{r} * cos(radians(99.473e0 * rn + {angle}))", f"{r} * sin(radians(99.473e0 * rn + {angle}))", f"1.5514e0 * rn + {z}")
    return [f"CASE WHEN label % 2 = 0 THEN {h} ELSE {t} END + {n}" for h, t, n in zip(helix, strand, noise)]


def _folded(t):
    """Atoms of files whose chains are helices or strands; helices and every fifth residue have no H."""
    rows = _numbered(t)
    rn, even = F.col("rn"), F.col("label") % 2 == 0
    forth, side = F.floor(rn / 12) % 2 == 0, F.when(rn % 2 == 0, 1.0).otherwise(-1.0)
    out = []
    for k, (a, (along, up)) in enumerate(_STRAND.items()):
        j = rn % 12
        strand = [F.when(forth, 3.4 * j + along).otherwise(3.4 * (11 - j) - along), F.when(forth, 0.0).otherwise(4.9) + side * up, 10.0 * F.floor(rn / 24)]
        helix = strand
        if a in _HELIX:
            r, angle, z = _HELIX[a]
            helix = [r * F.cos(F.radians(99.473 * rn + angle)), r * F.sin(F.radians(99.473 * rn + angle)), 1.5514 * rn + z]
        place = [(F.when(even, h).otherwise(s) + 0.3 * F.get("embedding", F.lit(3 * k + c)).cast("double")).alias(x) for c, (h, s, x) in enumerate(zip(helix, strand, "xyz"))]
        out.append(F.struct(F.lit(a).alias("atom_name"), F.lit(a[0]).alias("element"), *place, (F.col("vec_id") * 8 + k).alias("pos")))
    pick = F.get(F.array(*[F.lit(v) for v in NAMES]), (F.col("vec_id") % 20).cast("int"))
    rows = rows.select(F.concat(F.lit("f"), F.col("label").cast("string")).alias("file_id"), F.lit(1).alias("model"), F.lit("A").alias("chain"), rn.cast("int").alias("res_num"), pick.alias("resname"), "label", F.inline(F.array(*out)))
    return rows.filter("atom_name <> 'H' OR (label % 2 = 1 AND res_num % 5 > 0)").drop("label")


_FOLDED = f"""base AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn, embedding AS e FROM embeddings),
atoms AS ({" UNION ALL ".join(f"SELECT 'f' || label AS file_id, CAST(rn AS INTEGER) AS res_num, ({_listed(NAMES)})[vec_id % 20 + 1] AS resname, '{a}' AS atom_name, '{a[0]}' AS element, " + ", ".join(f"{e} AS {c}" for e, c in zip(_folded_sql(a, k), "xyz")) + f", vec_id * 8 + {k} AS pos FROM base" + (" WHERE label % 2 = 1 AND rn % 5 > 0" if a == "H" else "") for k, a in enumerate(_STRAND))})"""


@query(f"""WITH {_FOLDED}, {_places(["N", "CA", "C", "O", "H"])},
l AS (SELECT *, {", ".join(f"lag(c_{c}) OVER w AS b_{c}, lag(o_{c}) OVER w AS a_{c}" for c in "xyz")} FROM placed WINDOW w AS (PARTITION BY file_id ORDER BY res_num)),
k AS (SELECT *, coalesce({_far(_v("b"), _v("n"))} <= 2.5, false) AS linked, {_far(_v("b"), _v("a"))} AS co FROM l),
r AS (SELECT *, CAST(sum(CASE WHEN linked THEN 1 ELSE 10 END) OVER (PARTITION BY file_id ORDER BY res_num ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n,
      {", ".join(f"CASE WHEN resname <> 'PRO' THEN coalesce(h_{c}, CASE WHEN linked THEN n_{c} + (b_{c} - a_{c}) / co END) END AS q_{c}" for c in "xyz")} FROM k),
e AS (SELECT d.file_id, c.n AS co, d.n AS nh, 0.084 * 332 * (1 / {_far(_v("c.o"), _v("d.n"))} + 1 / {_far(_v("c.c"), _v("d.q"))} - 1 / {_far(_v("c.o"), _v("d.q"))} - 1 / {_far(_v("c.c"), _v("d.n"))}) AS energy
      FROM r d JOIN r c ON d.file_id = c.file_id AND d.n <> c.n AND d.n <> c.n + 1 AND d.q_x IS NOT NULL AND {_far(_v("d.ca"), _v("c.ca"))} <= 9),
h AS (SELECT * FROM e WHERE energy < -0.5 QUALIFY row_number() OVER (PARTITION BY file_id, nh ORDER BY energy, co) <= 2),
turn AS (SELECT file_id, co AS t, nh - co AS reach FROM h WHERE nh - co IN (3, 4, 5)),
spiral AS (SELECT a.file_id, a.t, a.reach FROM turn a JOIN turn b ON a.file_id = b.file_id AND a.reach = b.reach AND a.t = b.t + 1),
one AS (
  SELECT a.file_id, a.co + 1 AS i, a.nh AS j, true AS parallel FROM h a JOIN h b ON a.file_id = b.file_id AND b.co = a.nh AND b.nh = a.co + 2
  UNION ALL SELECT a.file_id, a.co, a.nh, false FROM h a JOIN h b ON a.file_id = b.file_id AND b.co = a.nh AND b.nh = a.co
  UNION ALL SELECT a.file_id, a.co + 1, a.nh - 1, false FROM h a JOIN h b ON a.file_id = b.file_id AND b.co = a.nh - 2 AND b.nh = a.co + 2),
bridge AS (SELECT file_id, i, j, parallel FROM one WHERE abs(i - j) >= 3 UNION SELECT file_id, j, i, parallel FROM one WHERE abs(i - j) >= 3),
flag AS (
  SELECT file_id, unnest(range(t + 1, t + reach)) AS n, 'T' AS f FROM turn
  UNION ALL SELECT file_id, unnest(range(t, t + reach)), CASE reach WHEN 4 THEN 'H' WHEN 3 THEN 'G' ELSE 'I' END FROM spiral
  UNION ALL SELECT b.file_id, b.i, CASE WHEN EXISTS (SELECT 1 FROM bridge x WHERE x.file_id = b.file_id AND x.parallel = b.parallel AND
    (x.i = b.i + 1 AND x.j = b.j + CASE WHEN b.parallel THEN 1 ELSE -1 END OR x.i = b.i - 1 AND x.j = b.j - CASE WHEN b.parallel THEN 1 ELSE -1 END)) THEN 'E' ELSE 'B' END FROM bridge b
  UNION ALL SELECT m.file_id, m.n, 'S' FROM r m JOIN r a ON a.file_id = m.file_id AND a.n = m.n - 2 JOIN r b ON b.file_id = m.file_id AND b.n = m.n + 2
    WHERE -{_cosine(_v("a.ca"), _v("m.ca"), _v("b.ca"))} < cos(radians(70e0)) AND EXISTS (SELECT 1 FROM r x WHERE x.file_id = m.file_id AND x.n = m.n - 1) AND EXISTS (SELECT 1 FROM r x WHERE x.file_id = m.file_id AND x.n = m.n + 1)),
best AS (SELECT file_id, n, min(strpos('HEBGITS', f)) AS k FROM flag GROUP BY ALL)
SELECT r.file_id, r.res_num, coalesce('HEBGITS'[k], '-') AS ss FROM r LEFT JOIN best ON r.file_id = best.file_id AND r.n = best.n""")
def residue_secondary(t):
    """Secondary structure from hydrogen bonds; half of the files are helices, half strands."""
    return assign.secondary(_folded(t)).select("file_id", "res_num", "ss")


@query(f"""WITH {_FOLDED}, h AS (SELECT *, CASE element WHEN 'N' THEN 1.55 WHEN 'O' THEN 1.52 ELSE 1.7 END + 1.4 AS r FROM atoms WHERE element <> 'H'),
p AS (SELECT k, 1 - (2 * k + 1) / 40e0 AS up FROM (SELECT unnest(range(40)) AS k)),
u AS (SELECT up, sqrt(1 - up * up) * cos(k * 2.399963229728653e0) AS cx, sqrt(1 - up * up) * sin(k * 2.399963229728653e0) AS cy FROM p),
near AS (SELECT a.file_id, a.pos, b.x, b.y, b.z, b.r FROM h a JOIN h b ON a.file_id = b.file_id AND a.pos <> b.pos AND {_far(("a.x", "a.y", "a.z"), ("b.x", "b.y", "b.z"))} < a.r + b.r),
hidden AS (SELECT DISTINCT h.file_id, h.pos, up FROM h CROSS JOIN u JOIN near b ON b.file_id = h.file_id AND b.pos = h.pos AND {_dot(("(h.x + h.r * cx - b.x)", "(h.y + h.r * cy - b.y)", "(h.z + h.r * up - b.z)"), ("(h.x + h.r * cx - b.x)", "(h.y + h.r * cy - b.y)", "(h.z + h.r * up - b.z)"))} < b.r * b.r),
n AS (SELECT file_id, pos, count(*) AS n FROM hidden GROUP BY ALL)
SELECT h.file_id, res_num, round(sum((40 - coalesce(n.n, 0)) / 40e0 * 4 * pi() * r * r), 5) AS asa FROM h LEFT JOIN n ON h.file_id = n.file_id AND h.pos = n.pos GROUP BY h.file_id, res_num""")
def residue_surface(t):
    """The surface that a probe reaches, by 40 points an atom."""
    return _rounded(assign.surface(_folded(t), 40).select("file_id", "res_num", "asa"), ["asa"], 5)


@query(f"""WITH {_ATOMS}, r AS (SELECT file_id, res_num, any_value(resname) AS name, avg(bfactor) AS b FROM atoms GROUP BY file_id, res_num),
n AS (SELECT *, lag(res_num) OVER w = res_num - 1 AS before_, lead(res_num) OVER w = res_num + 1 AS after_, lag(b) OVER w AS b0, lead(b) OVER w AS b1, lag(name) OVER w AS n0, lead(name) OVER w AS n1 FROM r WINDOW w AS (PARTITION BY file_id ORDER BY res_num)),
c AS (SELECT *, list_position({_listed(NAMES)}, name) - 1 + CASE WHEN after_ AND n1 = 'PRO' THEN 100 ELSE 0 END AS coil FROM n)
SELECT file_id, res_num, CASE WHEN before_ THEN n0 ELSE '' END AS "RESNAME_im1", CASE WHEN after_ THEN n1 ELSE '' END AS "RESNAME_ip1", round(CASE WHEN before_ THEN b0 ELSE 0 END, 6) AS "AVG_B_im1", round(CASE WHEN after_ THEN b1 ELSE 0 END, 6) AS "AVG_B_ip1",
       coil + 1 + CASE WHEN name = 'CYS' THEN -2.8 ELSE 0 END AS "RCOIL_CA", CASE name {" ".join(f"WHEN '{k}' THEN {v}" for k, v in lookup.HYDROPHOBICITY.items())} END AS "HYDROPHOBICITY", 4.5 AS "PH" FROM c""")
def residue_triples(t):
    rows = _atoms(t)
    spark = rows.sparkSession
    names = rows.groupBy(*residue.KEY).agg(F.min("resname").alias("RESNAME"))
    table = residue.mean_bfactor(rows).join(names, residue.KEY).withColumn("CYS_OX", F.col("RESNAME") == "CYS").withColumn("PH", F.lit(4.5))
    coil = spark.createDataFrame([(c, a, r, float(k + i + shift)) for c, shift in (("ala", 0), ("pro", 100)) for i, a in enumerate(("H", "CA", "HA", "C", "CB", "N")) for k, r in enumerate(NAMES)], lookup.COIL_SCHEMA)
    out = features.preprocess(features.triple(table, coil))
    return _rounded(out.select("file_id", "res_num", "RESNAME_im1", "RESNAME_ip1", "AVG_B_im1", "AVG_B_ip1", "RCOIL_CA", "HYDROPHOBICITY", "PH"), ["AVG_B_im1", "AVG_B_ip1", "RCOIL_CA"])


@query()
def structures_alike(t):
    """Rows only: chains of 21 places, one an embedding, the vector's triples summed up; every hundredth against all."""
    e, k = F.col("embedding"), F.col("k")
    step = lambda i: F.aggregate(F.transform(F.sequence(F.lit(0), k), lambda j: F.get(e, j * 3 + i).cast("double")), F.lit(0.0), lambda a, b: a + b * 8)
    points = t("embeddings").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(20)))).select(F.col("vec_id").alias("target"), k.alias("pos"), *[step(i).alias(c) for i, c in enumerate("xyz")])
    found = structure_search.search(points.filter("target % 100 = 0").withColumnRenamed("target", "query"), points, least=5)
    return found.select("query", "target", "votes", F.round("tmscore", 6).alias("tmscore"), F.round("rmsd", 6).alias("rmsd"), "aligned", "rank")


# files as lines


@query(f"""WITH {_ATOMS} SELECT file_id, res_num, atom_name, resname, element, het, bfactor, {", ".join(f"round({c}, 3) AS {c}" for c in "xyz")} FROM everything""")
def structure_lines(t):
    """Atoms written as records and read again."""
    lines = structure.as_lines(_everything(t)).withColumnRenamed("file_id", "file")
    return structure.atoms(lines).select("file_id", "res_num", "atom_name", "resname", "element", "het", "bfactor", "x", "y", "z")


@query(f"""WITH {_ATOMS}, m AS (SELECT * REPLACE (CASE resname WHEN 'ALA' THEN 'MSE' WHEN 'ARG' THEN 'UNK' ELSE resname END AS resname) FROM everything)
SELECT file_id, res_num, CASE resname WHEN 'MSE' THEN 'MET' ELSE resname END AS resname, atom_name FROM m WHERE resname NOT IN ('UNK', 'HOH')""")
def structure_repaired(t):
    """Names mapped or dropped, a second model and later residues of the same number left out."""
    rows = _everything(t).withColumn("resname", F.when(F.col("resname") == "ALA", "MSE").when(F.col("resname") == "ARG", "UNK").otherwise(F.col("resname")))
    second = rows.withColumns({"model": F.lit(2), "pos": F.col("pos") + 1_000_000})
    again = rows.filter("NOT het").withColumns({"icode": F.lit("A"), "resname": F.lit("TRP"), "pos": F.col("pos") + 2_000_000}).join(rows.filter("resname NOT IN ('UNK', 'HOH')").select("file_id", "res_num").distinct(), ["file_id", "res_num"], "left_semi")
    return structure.repair(rows.unionByName(second).unionByName(again)).select("file_id", "res_num", "resname", "atom_name")


@query(f"""WITH {_ATOMS}, r AS (SELECT DISTINCT file_id, res_num, resname FROM atoms),
told AS (SELECT 'f' || (l_orderkey % 9) AS file_id, CAST(l_partkey % 60 AS INTEGER) AS res_num, max(l_quantity) AS value, max(l_tax) AS score, min(l_discount) AS cov FROM lineitem GROUP BY ALL),
j AS (SELECT r.*, t.value, t.score, t.cov, t.value IS NOT NULL AND r.res_num % 4 > 0 AS valid FROM r LEFT JOIN told t ON r.file_id = t.file_id AND r.res_num = t.res_num)
SELECT file_id, res_num, valid, value AS "VALUE", round(CASE WHEN valid THEN value - res_num END, 6) AS "Y", CASE WHEN valid THEN score ELSE 0 END AS "SCORE", CASE WHEN valid THEN cov ELSE 0 END AS "COV", CASE WHEN valid THEN 1e0 ELSE 0e0 END AS "MATCH" FROM j""")
def transferred_inputs(t):
    """Features with transferred values for training and prediction: every fourth residue has another name there, and some files have none."""
    table = _atoms(t).select(*residue.KEY, F.col("resname").alias("RESNAME")).distinct()
    told = t("lineitem").groupBy(F.concat(F.lit("f"), (F.col("l_orderkey") % 9).cast("string")).alias("file_id"), (F.col("l_partkey") % 60).cast("int").alias("res_num")).agg(F.max("l_quantity").alias("value"), F.max("l_tax").alias("score"), F.min("l_discount").alias("cov"))
    named = told.join(table, ["file_id", "res_num"]).withColumn("RESNAME", F.when(F.col("res_num") % 4 > 0, F.col("RESNAME")).otherwise("other")).withColumn("match", F.lit(1.0))
    out = features.with_transferred(table, named, F.col("res_num").cast("double"))
    return out.select("file_id", "res_num", "valid", "VALUE", F.round("Y", 6).alias("Y"), "SCORE", "COV", "MATCH")


@query(f"""WITH {_ATOMS}, p AS (SELECT 'f' || (s_suppkey % 7) AS file_id, min(s_nationkey / 4e0) AS ph FROM supplier GROUP BY ALL)
SELECT r.file_id, r.res_num, coalesce(ph, 5e0) AS "PH" FROM (SELECT DISTINCT file_id, res_num FROM atoms) r LEFT JOIN p ON r.file_id = p.file_id""")
def residue_ph(t):
    """The pH that is stated for a file, else the default."""
    stated = t("supplier").select(F.concat(F.lit("f"), (F.col("s_suppkey") % 7).cast("string")).alias("file_id"), (F.col("s_nationkey") / 4).alias("ph"))
    return features.with_ph(_atoms(t).select("file_id", "res_num").distinct(), stated)


@query(f"""WITH {_ATOMS}, alt AS (
  SELECT file_id, res_num, resname, atom_name, k, x + k * 0.25 AS x, CASE WHEN k = 2 AND pos % 5 = 0 THEN NULL ELSE ((pos * 7 + k * 3) % 11) / 10e0 END AS occupancy, pos * 4 + k AS line_no FROM everything, (SELECT unnest(range(3)) AS k) WHERE k = 0 OR pos % 3 = 0)
SELECT file_id, res_num, atom_name, CAST(count(*) AS BIGINT) AS alternates, round(arg_max(x, (coalesce(occupancy, -1) * 10 + 10) * 1000000000 - line_no), 6) AS x, max(occupancy) AS occupancy FROM alt GROUP BY file_id, res_num, resname, atom_name""")
def structure_alternates(t):
    """Of several places of an atom the one with the highest occupancy, the first in the file where several are equal or none is stated."""
    rows = _everything(t)
    each = F.explode(F.when(F.col("pos") % 3 == 0, F.sequence(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0))))
    rows = rows.withColumn("k", each).withColumns({"altloc": F.substring(F.lit("ABC"), F.col("k") + 1, F.lit(1)), "x": F.col("x") + F.col("k") * 0.25})
    occupancy = F.when((F.col("k") < 2) | (F.col("pos") % 5 != 0), ((F.col("pos") * 7 + F.col("k") * 3) % 11) / F.lit(10.0))
    rows = rows.withColumns({"occupancy": occupancy, "pos": F.col("pos") * 4 + F.col("k")})
    counts = rows.groupBy("file_id", "res_num", "resname", "atom_name").agg(F.count(F.lit(1)).alias("alternates"))
    chosen = structure.one_place(rows).join(counts, ["file_id", "res_num", "resname", "atom_name"])
    return _rounded(chosen.select("file_id", "res_num", "atom_name", "alternates", "x", "occupancy"), ["x"])


@query(f"""WITH {_ATOMS}, r AS (SELECT DISTINCT file_id, res_num, '{"".join(structure.L.THREE_TO_ONE[n] for n in NAMES)}'[list_position({_listed(NAMES)}, resname)] AS letter FROM atoms)
SELECT file_id AS id, string_agg(letter, '' ORDER BY res_num) AS sequence, max(res_num) AS last FROM r GROUP BY file_id""")
def sequence_files(t):
    """Sequences of chains, written as FASTA and read again."""
    chains = structure.sequences(_everything(t))
    blocks = text.as_fasta(chains, "file_id", "sequence", 20)
    lines = blocks.select(F.lit("all").alias("file"), F.monotonically_increasing_id().alias("block"), F.posexplode(F.split("line", "\n")).alias("pos", "line"))
    read = text.fasta(lines.withColumn("pos", F.col("block") * 1000 + F.col("pos")).drop("block"))
    return read.join(chains.select(F.col("file_id").alias("id"), F.array_max("numbers").alias("last")), "id").select("id", "sequence", "last")


#: Places that a section of a file of labels may take: more than four a part.
_SECTION = 10**12


@query("""
SELECT 'o' || k AS file, CAST(r AS INTEGER) AS resid, quantity + 100 AS "CA", CAST(NULL AS DOUBLE) AS "N",
       round(CASE r % 3 WHEN 0 THEN (quantity + 3) / 2 WHEN 1 THEN quantity END, 6) AS "HA", CASE WHEN r % 5 <> 0 THEN r % 10 / 10 END AS s2, k / 10 AS ph
FROM (SELECT l_orderkey % 50 AS k, l_partkey AS r, max(l_quantity) AS quantity FROM lineitem GROUP BY ALL)""")
def label_files(t):
    """Files of labels, fifty of them, with three sections: a residue is a part; one alpha hydrogen, two or none."""
    lines = t("lineitem").groupBy((F.col("l_orderkey") % 50).alias("k"), F.col("l_partkey").alias("r")).agg(F.max("l_quantity").alias("ha"))
    at = lambda section, row, words: F.struct((F.lit(section * _SECTION) + row).alias("pos"), F.concat_ws(" ", *words).alias("line"))
    number = lambda c: F.round(c, 2).cast("string")
    row, r = F.col("r") * 4, F.col("r").cast("string")
    rows = F.array(at(2, row, [r, F.lit("A"), F.lit("CA"), number(F.col("ha") + 100)]), at(2, row + 1, [r, F.lit("A"), F.when(F.col("r") % 3 < 2, "HA2"), F.when(F.col("r") % 3 < 2, number(F.col("ha")))]), at(2, row + 2, [r, F.lit("A"), F.when(F.col("r") % 3 == 0, "HA3"), F.when(F.col("r") % 3 == 0, "3.0")]))
    rows = F.concat(rows, F.array(at(4, row, [r, (F.col("r") % 10 / 10).cast("string"), F.when(F.col("r") % 5 == 0, "C").otherwise("A")])))
    body = lines.select("k", F.inline(rows))
    titles = lines.select("k").distinct().select("k", F.inline(F.array(*[F.struct(F.lit(s * _SECTION - 5).alias("pos"), F.lit(x).alias("line")) for s, x in ((1, "REMARK pH and S2 follow"), (2, "FORMAT %4d"), (4, "RESID S2 RESNAME"), (5, "pH"))], F.struct(F.lit(2 * _SECTION - 4).alias("pos"), F.lit("").alias("line")), F.struct(F.lit(5 * _SECTION - 4).alias("pos"), (F.col("k") / 10).cast("string").alias("line")))))
    every = body.unionByName(titles).select(F.concat(F.lit("o"), F.col("k").cast("string")).alias("file"), "pos", "line")
    numbered = stash(W.line_numbers(every, ["file"], "pos", "pos"), "label-lines")  # read many times below
    shifts = labels.shifts(numbered)
    out = labels.wide(shifts).join(labels.order_parameters(numbered, shifts), ["file", "resid"]).join(labels.stated_ph(numbered), "file")
    return out.select("file", "resid", "CA", "N", F.round("HA", 6).alias("HA"), "s2", "ph")


@query("""SELECT 'p' || p_partkey AS file, CASE WHEN p_partkey % 3 > 0 THEN p_size + CAST(p_partkey % 100 AS DOUBLE) / 100 END AS resolution FROM part""")
def resolution_lines(t):
    stated = F.concat(F.lit("REMARK   2 RESOLUTION.    "), F.format_string("%d.%02d", "p_size", F.col("p_partkey") % 100), F.lit(" ANGSTROMS."))
    lines = F.array(F.lit("HEADER 2 RESOLUTION"), F.when(F.col("p_partkey") % 3 > 0, stated).otherwise("none"), F.when(F.col("p_partkey") % 3 > 0, "REMARK   2 RESOLUTION.    9.99 ANGSTROMS.").otherwise(""))
    return text.resolution(t("part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("file"), F.posexplode(lines).alias("pos", "line")))


@query("""SELECT 's' || s_suppkey || '.pdb' AS path, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey / 2 ELSE 5 END AS ph FROM supplier""")
def batch_lines(t):
    name = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".pdb"))
    line = F.concat_ws(" ", name, F.when(F.col("s_suppkey") % 2 == 0, (F.col("s_nationkey") / 2).cast("string")))
    lines = t("supplier").select(F.lit("list").alias("file"), F.col("s_suppkey").alias("pos"), F.explode(F.array(line, F.lit("  "))).alias("line"))
    return text.batch_list(lines)


@query(r"""
WITH h AS (SELECT o_custkey AS q, o_orderkey AS o, CAST(floor(o_totalprice) AS INTEGER) % 500 AS score, o_orderkey % 40 + 1 AS m FROM orders)
SELECT 'q' || q AS file, 't' || o AS target, CAST(score AS DOUBLE) AS score, CAST('1e-' || (score % 90) AS DOUBLE) AS evalue, CAST(m AS INTEGER) AS lmatch, CAST(m + 10 AS INTEGER) AS tmatch, repeat('A', CAST(m AS INTEGER)) || 'CD' AS source_seq, repeat('A', CAST(m AS INTEGER)) || '-D' AS target_seq,
       round(m / greatest(m + 10, 30), 9) AS coverage FROM h""")
def sequence_report(t):
    """Reports of a sequence search, one a customer, written and read; an alignment is in two lines, and a second one of the target doesn't count."""
    row, m = t("orders"), F.col("o_orderkey") % 40 + 1
    target, score = F.concat(F.lit("t"), F.col("o_orderkey").cast("string")), F.col("o_totalprice").cast("int") % 500
    a = F.repeat(F.lit("A"), m.cast("int"))
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    block = [said(">", target), said(" Identities = ", m, "/", m + 10, " (9%)"), said("Query  1  ", a, "  ", m), said("Sbjct  1  ", a, "  ", m), said("Query  ", m + 1, "  CD  ", m + 2), said("Sbjct  ", m + 1, "  -D  ", m + 1), F.lit(""), said(" Identities = 1/2 (50%)"), said("Query  1  XX  2"), said("Sbjct  1  XX  2")]
    listed = F.struct(F.col("o_orderkey").alias("pos"), said(target, "   ", score, "  1e-", score % 90).alias("line"))
    rest = [F.struct((10_000_000 + F.col("o_orderkey") * 20 + k).alias("pos"), x.alias("line")) for k, x in enumerate(block)]
    lines = row.select("o_custkey", F.inline(F.array(listed, *rest)))
    head = row.select("o_custkey").distinct().select("o_custkey", F.lit(-1).cast("long").alias("pos"), F.lit("Sequences producing significant alignments:").alias("line"))
    lines = lines.unionByName(head).select(said("q", F.col("o_custkey")).alias("file"), "pos", "line")
    found = reports.sequence_hits(lines, lines.select("file", F.lit(30).alias("length")).distinct())
    return found.withColumn("coverage", F.round("coverage", 9))


@query("""
WITH p AS (SELECT p_partkey, p_size, p_name, p_type FROM part)
SELECT p_type AS file, 'm' || p_partkey AS target, CAST(p_size AS DOUBLE) AS rmsd, round(p_size / 100, 6) AS tmscore,
       round(len(list_filter(list_zip(string_split(rpad(p_name, 25, '-'), ''), string_split(rpad('small ring', 25, '-'), '')), lambda q: q[1] = q[2] AND q[1] <> '-'))
             / len(list_filter(list_zip(string_split(rpad(p_name, 25, '-'), ''), string_split(rpad('small ring', 25, '-'), '')), lambda q: NOT (q[1] = '-' AND q[2] = '-'))), 9) AS coverage FROM p""")
def structure_report(t):
    """Reports of a structure search: matrices of scores with a title line, and the multiple alignment; a file is a type of parts."""
    parts = t("part").select(F.col("p_type").alias("file"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_size").cast("double").alias("size"), F.rpad("p_name", 25, "-").alias("sequence"))
    each = parts.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("id", "size"))).alias("m"))  # the row of a matrix

    def matrix(divisor):
        title = F.concat_ws(" ", F.lit("own.pdb"), F.transform("m", lambda x: F.concat(x["id"], F.lit(".pdb"))))
        own = F.concat_ws(" ", F.lit("own.pdb"), F.lit("0.0"), F.transform("m", lambda x: (x["size"] / divisor).cast("string")))
        return each.select("file", F.posexplode(F.array(title, own, F.lit("other.pdb 1 2"))).alias("pos", "line"))

    aligned = parts.select("file", F.concat("id", F.lit(".pdb")).alias("id"), "sequence")
    query_row = each.select("file", F.lit("own.pdb").alias("id"), F.rpad(F.lit("small ring"), 25, "-").alias("sequence"))
    out = reports.structure_hits(matrix(1), matrix(100), aligned.unionByName(query_row), "own.pdb")
    return out.withColumns({"tmscore": F.round("tmscore", 6), "coverage": F.round("coverage", 9)})


# transfer


@query("""
WITH s AS (SELECT o_custkey AS query, o_orderkey AS target, o_totalprice AS score, (o_orderkey % 60) AS tmatch, (o_orderkey % 60) * ((o_orderkey % 10) / 10) AS lmatch, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 1e-20 END AS evalue FROM orders),
f AS (SELECT * FROM s WHERE evalue <= 1e-10 AND ((tmatch >= 40 AND lmatch / tmatch >= 0.15) OR (tmatch >= 20 AND lmatch / tmatch >= 0.4))),
x AS (SELECT l_orderkey AS target, max(l_quantity) / 50 AS tmscore, min(l_discount) * 30 AS rmsd, max(l_tax) * 10 AS cover FROM lineitem GROUP BY l_orderkey HAVING max(l_quantity) / 50 > 0.8 AND min(l_discount) * 30 < 1.75 AND max(l_tax) * 10 > 0.3),
j AS (SELECT query, target, score / max(score) OVER (PARTITION BY query) AS score, tmscore FROM f JOIN x USING (target))
SELECT query, count(*) AS references_, round(max(tmscore), 9) AS best_tm, round(min(score), 9) AS least_score FROM j GROUP BY query""")
def both_searches(t):
    """Hits that pass the filters of both searches, scores as shares of the query's best, counted."""
    key = F.col("o_orderkey")
    sequence = t("orders").select(F.col("o_custkey").alias("query"), key.alias("target"), F.col("o_totalprice").alias("score"), (key % 60).alias("tmatch"), ((key % 60) * ((key % 10) / 10)).alias("lmatch"), F.when(key % 7 == 0, 1.0).otherwise(1e-20).alias("evalue"), F.lit(0.5).alias("coverage"))
    found = t("lineitem").groupBy(F.col("l_orderkey").alias("target")).agg((F.max("l_quantity") / 50).alias("tmscore"), (F.min("l_discount") * 30).alias("rmsd"), (F.max("l_tax") * 10).alias("coverage"))
    structural = found.join(sequence.select("query", "target"), "target")
    hits = transfer.both_hits(sequence, structural)
    summary = transfer.hit_summary(hits, identity="tmscore").select("query", F.col("references").alias("references_"), F.round("best_identity", 9).alias("best_tm"))
    return summary.join(hits.groupBy("query").agg(F.round(F.min("score"), 9).alias("least_score")), "query")


_ROWS = f"""a AS (SELECT p_partkey AS query, p_partkey + 1 AS target, string_split(rpad(translate(p_name, ' abcdefghijklmnopqrstuvwxyz', '-{(LETTERS * 2)[:26]}'), 20, '-'), '') AS s, string_split(rpad(translate(p_type, ' ABCDEFGHIJKLMNOPQRSTUVWXYZ', '-{(LETTERS * 2)[:26]}'), 20, '-'), '') AS g FROM part),
c AS (SELECT query, target, unnest(range(20)) AS pos, unnest(s) AS source_res, unnest(g) AS target_res FROM a),
n AS (SELECT *, sum(CASE WHEN source_res <> '-' THEN 1 ELSE 0 END) OVER w AS source_no, sum(CASE WHEN target_res <> '-' THEN 1 ELSE 0 END) OVER w AS target_no FROM c WINDOW w AS (PARTITION BY query, target ORDER BY pos))"""


def _aligned(t):
    put = lambda c, chars: F.rpad(F.translate(c, " " + chars, "-" + (LETTERS * 2)[:26]), 20, "-")
    return t("part").select(F.col("p_partkey").alias("query"), (F.col("p_partkey") + 1).alias("target"), put("p_name", "abcdefghijklmnopqrstuvwxyz").alias("a"), put("p_type", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("b"))


@query(f"""WITH {_ROWS}, m AS (SELECT *, lead(target_res) OVER (PARTITION BY query, target ORDER BY pos) AS next_res FROM n WHERE target_res <> '-')
SELECT query, target, CAST(source_no AS BIGINT) AS source_no, CAST(target_no AS BIGINT) AS target_no, source_res, target_res,
       round(target_no + 0.5 - CASE WHEN coalesce(next_res = 'P', false) THEN 100 ELSE 0 END - (strpos('{LETTERS}', target_res) - 1), 6) AS value
FROM m WHERE source_res <> '-' AND (source_res = target_res OR (strpos('{LETTERS}', source_res) + strpos('{LETTERS}', target_res)) % 3 = 0) AND target_no <= 9""")
def transfer_chain(t):
    """Labels of a target on the aligned residues of a query that are the same or similar, less the target's own random coil."""
    aligned = _aligned(t).select("query", "target", F.posexplode(F.arrays_zip(search.letters(F.col("a")).alias("source_res"), search.letters(F.col("b")).alias("target_res"))).alias("pos", "p")).select("query", "target", "pos", "p.*")
    spark = aligned.sparkSession
    similar = spark.createDataFrame([(a, b, 1.0 if a == b or (i + j + 2) % 3 == 0 else -1.0) for i, a in enumerate(LETTERS) for j, b in enumerate(LETTERS)], lookup.SUBSTITUTION_SCHEMA)
    told = t("part").select((F.col("p_partkey") + 1).alias("target"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(9).cast("long"))).alias("ordinal"), F.lit("CA").alias("atom")).withColumn("value", F.col("ordinal") + 0.5)
    coil = spark.createDataFrame([(c, "CA", r, float(k + shift)) for c, shift in (("ala", 0), ("pro", 100)) for k, r in enumerate(LETTERS)], lookup.COIL_SCHEMA)
    out = transfer.transfer_labels(aligned, told, similar, strict=1, coil=coil)
    return out.select("query", "target", "source_no", "target_no", "source_res", "target_res", F.round("value", 6).alias("value"))


@query(f"""WITH {_ROWS} SELECT query, CAST(source_no AS BIGINT) AS ordinal, source_res AS letter FROM n WHERE source_res <> '-' AND target_res <> '-'""")
def reconciled_letters(t):
    return transfer.reconciled(_aligned(t), ["query"])


@query(f"""WITH {_ATOMS}, l AS (SELECT 'f' || (l_orderkey % 10) AS file_id, CAST(l_partkey % 60 AS INTEGER) AS res_num, max(l_quantity) AS "CA" FROM lineitem GROUP BY ALL)
SELECT r.file_id, r.res_num, l."CA", CAST(NULL AS DOUBLE) AS "N" FROM (SELECT DISTINCT file_id, res_num FROM atoms) r LEFT JOIN l ON r.file_id = l.file_id AND r.res_num = l.res_num""")
def training_rows(t):
    """Features with labels by number; label columns that a table lacks are null."""
    table = _atoms(t).select(*residue.KEY).distinct()
    told = t("lineitem").groupBy(F.concat(F.lit("f"), (F.col("l_orderkey") % 10).cast("string")).alias("file_id"), F.lit("A").alias("chain"), (F.col("l_partkey") % 60).cast("int").alias("resid")).agg(F.max("l_quantity").alias("CA"))
    return features.training_table(table, told).select("file_id", "res_num", "CA", "N")


@query("""
SELECT o_orderkey, o_orderpriority, o_totalprice AS pred, CASE WHEN o_orderpriority = CASE WHEN c_custkey % 2 = 0 THEN '5-LOW' ELSE '1-URGENT' END AND c_acctbal >= 0 AND c_acctbal <= 5000 THEN c_acctbal END AS price_real
FROM orders JOIN customer ON o_custkey = c_custkey""")
def targets_in_range(t):
    """Predictions with their targets, null where names differ or the target is outside its range."""
    preds = t("orders").select("o_orderkey", F.col("o_custkey").alias("key"), "o_orderpriority", F.col("o_totalprice").alias("pred"))
    told = t("customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 2 == 0, "5-LOW").otherwise("1-URGENT").alias("o_orderpriority"), F.col("c_acctbal").alias("price"))
    return evaluate.against_targets(preds, told, ["key"], "o_orderpriority", ["price"], {"price": (0.0, 5000.0)}).drop("key")
