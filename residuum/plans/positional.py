"""Queries on texts, conversations and points: windows over turns, sections, search, spatial joins, geometry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from residuum.functions import label_text as L
from residuum.functions import rules as R
from residuum.functions import vectors as V
from residuum.operators import search, spatial, transfer
from residuum.operators import windows as W
from residuum.plans.registry import query


@query("SELECT conv_id, turn, " + ", ".join(f"{f}(role, {k}, 'NONE') OVER w AS role_{s}{k}" for k in (1, 2, 3) for s, f in (("m", "lag"), ("p", "lead"))) + " FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def flank_k(t):
    out = W.flanks(t("conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], "role", 3)
    return out.drop("role")


@query("""
WITH b AS (SELECT conv_id, turn, length(text) AS n, coalesce(length(text) < 150, false) AS bad FROM conversations),
h AS (SELECT *, bad OR coalesce(lag(bad) OVER w, false) OR coalesce(lead(bad) OVER w, false) AS hit FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN NOT hit THEN n END AS n FROM h""")
def neighbor_null(t):
    turns = t("conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return W.null_around(turns, ["conv_id"], ["turn"], F.col("n") < 150, ["n"])


@query("""
WITH c AS (SELECT conv_id, turn, role, CASE WHEN lead(turn) OVER w = turn + 1 AND lead(role) OVER w = 'assistant' THEN 'pro' ELSE 'ala' END AS context
           FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, role, context, CASE WHEN role = 'user' THEN CASE context WHEN 'pro' THEN 4.5 ELSE 4.25 END WHEN role = 'system' THEN 1.5 END AS coil FROM c""")
def rc_context_lookup(t):
    turns = t("conversations").select("conv_id", "turn", "role", F.lit("H").alias("atom"))
    table = "SELECT * FROM VALUES ('pro', 'user', 'H', 4.5D), ('ala', 'user', 'H', 4.25D), ('pro', 'system', 'H', 1.5D), ('ala', 'system', 'H', 1.5D) AS v(context, resname, atom, value)"
    coil = turns.sparkSession.sql(table)
    out = transfer.add_baseline(transfer.with_context(turns, ["conv_id"], "turn", "role", "assistant"), F.broadcast(coil), "role")  # four rows
    return out.select("conv_id", "turn", "role", "context", "coil")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
m AS (SELECT doc_id, max(CASE WHEN contains(line, 'License') THEN pos END) AS license_at, max(CASE WHEN contains(line, 'the') THEN pos END) AS word_at FROM l GROUP BY doc_id)
SELECT l.doc_id, count(*) AS n_lines, CAST(max(license_at) AS BIGINT) AS license_at, CAST(max(word_at) AS BIGINT) AS word_at,
       CAST(sum(CASE WHEN pos > word_at THEN length(line) ELSE 0 END) AS BIGINT) AS chars_after
FROM l JOIN m ON l.doc_id = m.doc_id GROUP BY l.doc_id""")
def section_slice(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    marked = W.sections(lines, ["doc_id"], "pos", "line", {"license_at": "License", "word_at": "the"})
    after = F.sum(F.when(F.col("pos") > F.col("word_at"), F.length("line")).otherwise(0))
    return marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max("license_at").cast("long").alias("license_at"), F.max("word_at").cast("long").alias("word_at"), after.cast("long").alias("chars_after"))


@query("""
WITH x AS (SELECT doc_id, strpos(text, 'the') AS key_at, list_concat(regexp_extract_all(text, '(\\d+\\.\\d+)', 1), regexp_extract_all(text, ' (\\d{1,2}) ', 1)) AS n, text FROM documents),
y AS (SELECT doc_id, key_at, n, list_transform(n, lambda v: abs(strpos(text, v) - key_at)) AS away FROM x)
SELECT doc_id, CASE WHEN key_at > 0 AND len(n) > 0 THEN CAST(n[list_position(away, list_min(away))] AS DOUBLE) ELSE 5.0 END AS number FROM y""")
def nearest_number(t):
    return t("documents").select("doc_id", L.nearest_number(F.col("text"), "the", 5.0).alias("number"))


@query("""
WITH x AS (SELECT p_partkey, string_split(rpad(p_name, 40, '-'), '') AS a, string_split(rpad(p_type, 40, '-'), '') AS b FROM part),
y AS (SELECT p_partkey, list_filter(list_zip(a, b), lambda p: NOT (p[1] = '-' AND p[2] = '-')) AS p FROM x)
SELECT p_partkey, round(len(list_filter(p, lambda q: q[1] = q[2])) / len(p), 9) AS identity FROM y""")
def pairwise_from_msa(t):
    return t("part").select("p_partkey", F.round(search.identity(F.rpad("p_name", 40, "-"), F.rpad("p_type", 40, "-")), 9).alias("identity"))


_WORDS = "regexp_extract_all(text, '[^ \\n]+')"


@query(f"""
WITH d AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) >= 5),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS seed FROM d),
b AS (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) >= 5),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 4], ' ') AS seed FROM b),
s AS (SELECT item_id, doc_id, count(*) AS shared FROM bs JOIN ds USING (seed) GROUP BY ALL)
SELECT item_id, doc_id, shared, CAST(row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS INTEGER) AS rank FROM s""")
def seed_search(t):
    words = F.regexp_extract_all("text", F.lit("[^ \n]+"), F.lit(0))
    queries = search.seeds(t("benchmark"), "item_id", words, 5, " ")
    targets = search.seeds_among(t("documents"), "doc_id", words, 5, queries, " ")
    return search.seed_hits(queries, targets, "item_id", "doc_id")


@query()
def global_align(t):
    """Rows only: affine-gap alignment has no SQL. Each item with the next one."""
    letters = "abcdefghijklmnopqrstuvwxyz "
    score = [[4.0 if a == b and a < len(letters) else -1.0 for b in range(len(letters) + 1)] for a in range(len(letters) + 1)]
    items = t("benchmark").select("item_id", F.lower("text").alias("text"))
    pairs = items.join(items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next")), "item_id")
    return search.align_pairs(pairs, "text", "next", score, letters).select("item_id", "aligned.a", "aligned.b", "aligned.score")


def _points(t):
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return t("embeddings").select("vec_id", "label", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


_POINTS = "SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings"
_PAIRS = f"""p AS ({_POINTS}),
q AS (SELECT a.*, b.vec_id AS o_vec_id, b.label AS o_label, b.x AS o_x, b.y AS o_y, b.z AS o_z,
      sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS dist FROM p a, p b WHERE a.vec_id <> b.vec_id)"""


def _near(t, radius: float):
    points = _points(t)
    return points, spatial.radius_join(points, points, radius).filter("vec_id <> o_vec_id")


@query(f"""WITH {_PAIRS}, s AS (SELECT vec_id, sum(exp(0.05 - dist)) AS c FROM q WHERE dist <= 0.1 GROUP BY vec_id)
SELECT p.vec_id, round(tanh(0.8 * coalesce(c, 0) / 10) - 0.1, 8) AS s2 FROM p LEFT JOIN s ON p.vec_id = s.vec_id""")
def radius_contact(t):
    points, pairs = _near(t, 0.1)
    sums = spatial.contact_sum(pairs, ["vec_id"], 0.05)
    s2 = R.contact_order(F.coalesce("contact", F.lit(0.0)) / 10)
    return points.join(sums, "vec_id", "left").select("vec_id", F.round(s2, 8).alias("s2"))


@query(f"""WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, o_vec_id) AS k FROM q WHERE dist <= 0.1 AND label <> o_label)
SELECT vec_id, o_vec_id, round(dist, 9) AS dist FROM r WHERE k = 1""")
def nearest_typed(t):
    points = _points(t)
    found = spatial.nearest(points, points, 0.1, ["vec_id"], ["o_vec_id"], valid=F.expr("vec_id <> o_vec_id AND label <> o_label"))
    return found.select("vec_id", "o_vec_id", F.round("dist", 9).alias("dist"))


@query(f"""WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, o_vec_id) AS k FROM q WHERE dist <= 0.1)
SELECT vec_id, o_vec_id, round(dist, 9) AS dist FROM r WHERE k = 2""")
def second_nearest(t):
    points = _points(t)
    return spatial.nearest(points, points, 0.1, ["vec_id"], ["o_vec_id"], 2, F.expr("vec_id <> o_vec_id")).select("vec_id", "o_vec_id", F.round("dist", 9).alias("dist"))


@query(f"""WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, o_vec_id) AS k FROM q WHERE dist <= 0.05 AND label = o_label AND abs(vec_id - o_vec_id) >= 4)
SELECT p.vec_id, coalesce(o_vec_id, 0) AS partner, coalesce(round(r.dist, 9), 0) AS dist, CAST(o_vec_id IS NOT NULL AS INTEGER) AS found FROM p LEFT JOIN r ON p.vec_id = r.vec_id AND k = 1""")
def first_valid_candidate(t):
    points = _points(t)
    valid = F.abs(F.col("vec_id") - F.col("o_vec_id")) >= 4
    hit = spatial.nearest(points, points, 0.05, ["vec_id"], ["o_vec_id"], valid=valid, keys=["label"]).select("vec_id", "o_vec_id", "dist")
    return points.join(hit, "vec_id", "left").select("vec_id", F.coalesce("o_vec_id", F.lit(0)).alias("partner"), F.coalesce(F.round("dist", 9), F.lit(0.0)).alias("dist"), F.col("o_vec_id").isNotNull().cast("int").alias("found"))


@query(f"""WITH {_PAIRS} SELECT vec_id, count(*) FILTER (x * (o_x - x) + y * (o_y - y) + z * (o_z - z) > 0) AS up, count(*) FILTER (x * (o_x - x) + y * (o_y - y) + z * (o_z - z) <= 0) AS down
FROM q WHERE dist <= 0.1 GROUP BY vec_id""")
def half_sphere(t):
    _, pairs = _near(t, 0.1)
    direction = V.dot(V.columns("x", "y", "z"), V.sub(V.columns("o_x", "o_y", "o_z"), V.columns("x", "y", "z")))
    return spatial.half_sphere(pairs, ["vec_id"], direction)


@query(f"WITH {_PAIRS} SELECT vec_id, o_vec_id, label, round(dist, 9) AS dist FROM q WHERE dist <= 0.05 AND label = o_label AND abs(vec_id - o_vec_id) >= 4")
def bond_pairs(t):
    points = _points(t)
    return spatial.disulfides(points, ["label"], "vec_id", 0.05).select("vec_id", "o_vec_id", "label", F.round("dist", 9).alias("dist"))


@query(f"""WITH p AS ({_POINTS}), c AS (SELECT label, vec_id % 8 AS g, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM p GROUP BY ALL)
SELECT vec_id, round(sum(1 / pow((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz) + 0.01, 1.5)), 4) AS field FROM p JOIN c USING (label) GROUP BY vec_id""")
def ring_field(t):
    points = _points(t)
    centres = points.groupBy("label", (F.col("vec_id") % 8).alias("g")).agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"])
    gap = V.sub(V.columns("x", "y", "z"), V.columns("cx", "cy", "cz"))
    return points.join(centres, "label").groupBy("vec_id").agg(F.round(F.sum(1 / F.pow(V.dot(gap, gap) + 0.01, F.lit(1.5))), 4).alias("field"))


@query()
def ring_current(t):
    """Rows only: ``residue_ring_currents`` has the SQL. Rings: all points of a label, five by five in order of id."""
    points = _points(t)
    return spatial.ring_current(points, _rings(points), ["label"], ["vec_id"], F.lit(1.0), F.lit(1.0)).withColumn("ring", F.round("ring", 6))


def _rings(points):
    """All points of a label in rings of five, by rank; a rest of fewer is no ring."""
    ranked = points.withColumn("g", F.floor((F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1) / 5))
    ring = F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "x", "y", "z"))), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), c["z"].alias("z")))
    return ranked.groupBy("label", "g").agg(ring.alias("ring")).filter(F.size("ring") == 5)


@query("""
WITH x AS (SELECT vec_id, embedding AS a, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(a, b), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2])))), 6) AS l2 FROM x WHERE b IS NOT NULL""")
def l2_matrix(t):
    before = F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    pairs = t("embeddings").withColumn("before", before).filter("before IS NOT NULL")
    gap = F.zip_with("embedding", "before", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    return pairs.select("vec_id", F.round(F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, v: s + v)), 6).alias("l2"))


@query(f"""
WITH p AS ({_POINTS}),
s AS (SELECT vec_id, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, z - lag(z) OVER w AS az, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS by_, lead(z) OVER w - z AS bz,
             lead(x, 2) OVER w - lead(x) OVER w AS cx, lead(y, 2) OVER w - lead(y) OVER w AS cy, lead(z, 2) OVER w - lead(z) OVER w AS cz
      FROM p WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
n AS (SELECT *, ay * bz - az * by_ AS n1x, az * bx - ax * bz AS n1y, ax * by_ - ay * bx AS n1z, by_ * cz - bz * cy AS n2x, bz * cx - bx * cz AS n2y, bx * cy - by_ * cx AS n2z FROM s),
d AS (SELECT vec_id, atan2(sqrt(bx * bx + by_ * by_ + bz * bz) * (ax * n2x + ay * n2y + az * n2z), n1x * n2x + n1y * n2y + n1z * n2z) AS t FROM n)
SELECT vec_id, round(coalesce(cos(t), 0), 8) AS cos_t, round(coalesce(sin(t), 0), 8) AS sin_t FROM d""")
def dihedral(t):
    w = Window.partitionBy("label").orderBy("vec_id")
    moved = _points(t).withColumns({f"{c}{k}": F.lead(c, k).over(w) if k > 0 else F.lag(c, 1).over(w) for c in "xyz" for k in (-1, 1, 2)})
    corner = lambda k: V.columns(*[f"`{c}{k}`" for c in "xyz"])
    cos, sin = V.cos_sin(V.dihedral(corner(-1), V.columns("x", "y", "z"), corner(1), corner(2)))
    return moved.select("vec_id", F.round(cos, 8).alias("cos_t"), F.round(sin, 8).alias("sin_t"))


def _weight(j: int, i: int) -> float:
    return ((i * 7 + j * 13) % 11 - 5) / 50


@query("SELECT vec_id, " + ", ".join(f"round(cos(list_sum(list_transform(embedding, lambda v, i: CAST(v AS DOUBLE) * ((((i - 1) * 7 + {j * 13}) % 11 - 5) / 50.0))) + {j}), 7) AS f{j}" for j in range(4)) + " FROM embeddings")
def random_features(t):
    lifted = R.random_fourier(F.col("embedding"), [[_weight(j, i) for i in range(64)] for j in range(4)], [float(j) for j in range(4)])
    return t("embeddings").select("vec_id", *[F.round(c, 7).alias(f"f{j}") for j, c in enumerate(lifted)])
