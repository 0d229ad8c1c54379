"""Null rules, curation, transfer, learning: small cases with results by hand, and properties."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from residuum.functions import label_text as L
from residuum.functions import rules as R
from residuum.operators import curate, evaluate, learn, transfer, trees
from residuum.operators import windows as W
from residuum.plans import features
from residuum.sources import tables


def column(spark, values, kind="double"):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, c {kind}")


def got(df, expr):
    return [r.v for r in df.orderBy("k").select(expr.alias("v")).collect()]


def test_null_rules(spark):
    df = column(spark, [float("nan"), None, 0.0, -2.0, 4.0])
    c = F.col("c")
    assert got(df, R.nan_to_null(c)) == [None, None, 0.0, -2.0, 4.0]
    clean = df.filter("k > 0")
    assert got(clean, R.power(c, -1)) == [0.0, 0.0, 0.0, 0.25]
    assert got(clean, R.clip(c, 3.0)) == [None, 0.0, -2.0, 3.0]
    assert got(clean, R.null_below(c, 0.0)) == [None, 0.0, None, 4.0]
    assert got(clean, R.less_baselines(F.lit(1.0), filled=[c])) == [1.0, 1.0, 3.0, -3.0]
    assert got(clean, R.less_baselines(F.lit(1.0), required=[c])) == [None, 1.0, 3.0, -3.0]


def test_names(spark):
    df = column(spark, ["ALA", "XXX", None], "string")
    assert got(df, L.one_letter(F.col("c"))) == ["A", None, None]
    assert got(df, L.one_letter(F.col("c"), "X")) == ["A", "X", "X"]
    assert got(column(spark, ["1HB", " DG", "N"], "string"), L.atom_name(F.col("c"))) == ["HB1", "HG", "N"]


def test_neighbours_need_their_number(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 6.0), ("a", 4, 7.0), ("b", 5, 8.0)], "g string, n int, v double")
    rows = {(r.g, r.n): (r.v_im1, r.v_ip1) for r in W.guarded(df, ["g"], "n", {"v": 0.0}).collect()}
    assert rows == {("a", 1): (0.0, 6.0), ("a", 2): (5.0, 0.0), ("a", 4): (0.0, 0.0), ("b", 5): (0.0, 0.0)}


def test_bad_rows_null_their_neighbours(spark):
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate([1.0, 2.0, None, 4.0, 5.0])], "g string, n int, v double")
    out = {r.n: r.v for r in W.null_around(df, ["g"], ["n"], F.col("v").isNull(), ["v"]).collect()}
    assert out == {0: 1.0, 1: None, 2: None, 3: None, 4: 5.0}
    ends = {r.n: r.v for r in W.null_around(df, ["g"], ["n"], F.lit(False), ["v"], ends=True).collect()}
    assert (ends[0], ends[1], ends[4]) == (None, 2.0, None)


def test_gaps_and_segments(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 4, "y")], "g string, n int, v string")
    assert [(r.n, r.v) for r in W.fill_gaps(df, ["g"], "n").orderBy("n").collect()] == [(1, "x"), (2, None), (3, None), (4, "y")]
    gap = F.col("n") - F.lag("n").over(W.chain_window(["g"], ["n"])) > 1
    assert [r.segment for r in W.segments(df.withColumn("gap", gap), ["g"], ["n"], F.col("gap")).orderBy("n").collect()] == [0, 1]


def test_curation(spark):
    df = column(spark, [1.0] * 50 + [1000.0, None])
    assert [r.k for r in curate.outliers(df, "c").filter("is_outlier").collect()] == [50]
    fitted = curate.medians(column(spark, [0.0, 1.0, 3.0, 0.0, None]), ["c"])
    assert got(curate.impute(column(spark, [0.0, 5.0, None]), fitted), F.col("c")) == [2.0, 5.0, None]
    listed = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert got(curate.exclude(column(spark, [1.0, 2.0]), listed, ["k"], ["c"]), F.col("c")) == [1.0, None]
    assert curate.check_order(spark.createDataFrame([("a", 0, 1), ("a", 1, 2)], "g string, p int, n int"), ["g"], "p", "n").count() == 2
    with pytest.raises(Exception, match="out of order"):
        curate.check_order(spark.createDataFrame([("a", 0, 2), ("a", 1, 2)], "g string, p int, n int"), ["g"], "p", "n").collect()


def test_targets_in_range_with_equal_names(spark):
    preds = spark.createDataFrame([(1, "A", 8.0), (2, "G", 8.0), (3, "A", 8.0), (4, "A", 8.0)], "n int, name string, H double")
    real = spark.createDataFrame([(1, "A", 7.0), (2, "A", 7.0), (3, "A", 1.0)], "n int, name string, H double")
    out = evaluate.against_targets(preds, real, ["n"], "name", ["H"], {"H": (2.0, None)})
    assert {r.n: r.H_real for r in out.collect()} == {1: 7.0, 2: None, 3: None}
    row = evaluate.errors(out, F.col("H"), F.col("H_real"), []).collect()[0]
    assert (row.n, row.rmse, row.min_abs) == (1, 1.0, 1.0)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(-5, 5), st.floats(0, 1)), min_size=1, max_size=8), st.floats(-3, 3))
def test_weights_ignore_a_common_score(spark, rows, more):
    def mean(extra):
        df = spark.createDataFrame([(1, float(v), float(s) + extra) for v, s in rows], "q int, v double, s double")
        return transfer.weighted_mean(df, ["q"], "v", R.softmax_weight(F.col("s"), F.lit(0.0)), 4.0).collect()[0].value

    want = sum(math.exp(5 * s) * v for v, s in rows) / sum(math.exp(5 * s) for _, s in rows)
    assert mean(0.0) == pytest.approx(max(-4, min(4, want)), abs=1e-9)
    assert mean(more) == pytest.approx(mean(0.0), rel=1e-6, abs=1e-9)


def test_pairs_are_symmetric(spark):
    pairs = transfer.symmetric(spark.createDataFrame([("A", "A", 4), ("A", "C", 0)], "a string, b string, score int"))
    assert {(r.a, r.b, r.score) for r in pairs.collect()} == {("A", "A", 4), ("A", "C", 0), ("C", "A", 0)}


def test_transfer_follows_the_alignment(spark):
    columns = [("A", "A"), ("-", "C"), ("D", "-"), ("E", "E"), ("F", "C")]
    alignment = spark.createDataFrame([("q", "t", k, a, b) for k, (a, b) in enumerate(columns)], "query string, target string, pos int, source_res string, target_res string")
    known = spark.createDataFrame([("t", 1, "H", 8.0), ("t", 3, "H", 9.0), ("t", 4, "H", 7.0)], "target string, ordinal long, atom string, value double")
    similar = spark.createDataFrame([("A", "A", 4), ("E", "E", 5), ("F", "C", -2)], "a string, b string, score int")
    found = lambda strict: {(r.source_no, r.value) for r in transfer.transfer_labels(alignment, known, similar, strict).collect()}
    assert found(0) == found(1) == {(1, 8.0), (3, 9.0)}
    assert found(2) == {(1, 8.0), (3, 9.0), (4, 7.0)}


def test_hits_and_defaults(spark):
    hits = spark.createDataFrame([("q", "a", 50.0, 1e-12, 30, 60, 0.5), ("q", "b", 50.0, 1e-12, 5, 60, 0.1), ("q", "c", 50.0, 1e-9, 60, 60, 0.5), ("q", "d", 50.0, 0.0, 25, 25, 1.0)], "query string, target string, score double, evalue double, lmatch int, tmatch int, coverage double")
    assert {r.target for r in transfer.sequence_hits(hits).collect()} == {"a", "d"}
    assert {r.target for r in transfer.sequence_hits(hits, exclude_self=True).collect()} == {"a"}
    out = transfer.or_default(spark.createDataFrame([(1,), (2,)], "n int"), spark.createDataFrame([(1, 5.0, 0.9)], "n int, value double, score double"), ["n"], ["score"])
    assert {r.n: (r.value, r.score) for r in out.collect()} == {1: (5.0, 0.9), 2: (None, 0.0)}


def test_forests_stack_and_fall_back(spark, tmp_path):
    rows = [(k, k % 5, float(k % 7), float(k % 3), float(k % 7) * 2 + k % 3, None if k % 4 else float(k % 7)) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, fold int, a double, b double, y double, t double")
    models = learn.stack(df, ["a", "b"], "y", "fold", 5, ["t"], trees=8, depth=6)
    assert set(models) == {"r0", "r1", "r2"} and models["r1"].getNumTrees == 8
    out = trees.predict(df, models["r0"], "p0", "fold")
    assert out.agg(F.corr("p0", "y")).first()[0] > 0.9
    out = models["r1"].transform(learn.assembled(out.withColumnRenamed("p0", "r0_pred"), ["a", "b", "r0_pred"]))
    assert out.agg(F.corr("pred", "y")).first()[0] > 0.95
    trees.save(spark, models["r0"], str(tmp_path / "m"))
    back = trees.load(spark, str(tmp_path / "m"))
    assert (back.names, back.groups, back.trees) == (("a", "b"), (0, 1, 2, 3, 4, -1), 8)
    assert trees.predict(df, back, "p", "fold").select("k", "p").collect() == trees.predict(df, models["r0"], "p", "fold").select("k", "p").collect()
    c = learn.fallback(F.col("t").isNotNull(), F.col("t"), F.col("a"), F.lit(1.0))
    assert df.select(F.sum(c)).first()[0] == sum((r[5] if r[5] is not None else r[2]) + 1 for r in rows)


def test_prediction_falls_back_where_nothing_valid_is_transferred(spark):
    rows = [("f", 1, "A", k, "ALA", 50.0, float(k % 5), float(k % 3), 2.0 * (k % 5) + k % 3) for k in range(60)]
    table = spark.createDataFrame(rows, "file_id string, model int, chain string, res_num int, RESNAME string, RCOIL_CA double, x1 double, x2 double, label double")
    known = table.withColumns({"r0_pred": F.col("label"), "Y": F.col("label"), "SCORE": F.lit(1.0), "COV": F.lit(1.0), "MATCH": F.lit(1.0)})
    names = ["x1", "x2"]
    inputs = {"r0": names, "r1": [*names, "r0_pred"], "r2": [*names, "Y", "SCORE", "COV", "MATCH", "r0_pred"]}
    models = {k: learn.forest("label", trees=2, subset="all", leaf=1, depth=8).fit(learn.assembled(known, v)) for k, v in inputs.items()}
    models["r0"] = trees.fit(known, names, "label", trees=3, subset=1.0, leaf=1, split=2)
    plain = table.drop("label")
    assert features.for_atom(plain, "CA") == names
    alone = {r.res_num: r.CA_X for r in features.predict(plain, "CA", models).collect()}
    assert alone == pytest.approx({r[3]: 50 + r[8] for r in rows})
    given = table.filter("res_num < 30").select("file_id", "model", "chain", "res_num", F.when(F.col("res_num") < 10, "GLY").otherwise("ALA").alias("RESNAME"), (F.col("label") + 50).alias("value"), F.lit(1.0).alias("score"), F.lit(1.0).alias("cov"), F.lit(1.0).alias("match"))
    both = features.predict(plain, "CA", models, given).collect()
    assert len(both) == 60 and all(r.CA_final == pytest.approx(r.CA_X) for r in both if r.res_num < 10 or r.res_num >= 30)
    assert [r.CA_final for r in both if 10 <= r.res_num < 30] == pytest.approx([50 + rows[r.res_num][8] for r in both if 10 <= r.res_num < 30])
    assert {r.res_num for r in both if r.CA_Y is None} == set(range(30, 60))


def test_labels_less_coil_and_rings(spark):
    table = spark.createDataFrame([(1, 10.0, 1.0, 0.5), (2, 20.0, None, 0.5), (3, None, 1.0, 0.5), (4, 30.0, 1.0, None), (5, 40.0, 1.0, 2.5)], "k int, CA double, RCOIL_CA double, CA_RC double")
    out = lambda **how: [r.CA for r in features.less_baselines(table, **how).orderBy("k").collect()]
    assert out() == [9.0, None, None, 29.0, 39.0]
    assert out(rings=True) == [8.5, None, None, 28.5, 36.5]
    none = table.withColumn("CA_RC", F.lit(None).cast("double"))
    assert [r.CA for r in features.less_baselines(none, rings=True).orderBy("k").collect()] == [9.0, None, None, 29.0, 39.0]


def test_tables_are_written_and_read_back(spark, tmp_path):
    table = spark.createDataFrame([(1, "a,b"), (2, None), (3, 'q"t')], "k int, v string")
    tables.write_csv(table, str(tmp_path / "t"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "t"), "k int, v string").collect())) == sorted(map(tuple, table.collect()))


def test_union_and_unambiguous_files(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(2.0, 1)], "w double, k int")
    assert [(r.k, r.v, r.w) for r in tables.union([a, b]).orderBy("v").collect()] == [(1, None, 2.0), (1, "x", None)]
    assert [r.k for r in tables.unambiguous(spark.createDataFrame([(1,), (1,), (2,)], "k int"), "k").collect()] == [2]


@pytest.mark.parametrize("few", [100_000, 3])
def test_quantiles_are_exact_however_rows_are_spread(spark, few, monkeypatch):
    import numpy as np

    from residuum.operators import ranks
    from residuum.operators.ranks import quantiles

    monkeypatch.setattr(ranks, "FEW", few)

    rng = np.random.default_rng(5)
    rows = [("a", float(x)) for x in rng.integers(0, 9, 400)] + [("b", float(x)) for x in rng.normal(size=301)] + [("c", 2.5), (None, 1.0), (None, 4.0), ("d", None)]
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.share): r.quantile for r in quantiles(spark.createDataFrame(rows, "g string, v double").repartition(7), "v", shares, ["g"]).collect()}
    want = {(g, s): float(np.quantile([v for h, v in rows if h == g], s)) for g in ("a", "b", "c", None) for s in shares}
    assert got == pytest.approx(want)
    assert quantiles(spark.createDataFrame([], "v double"), "v", shares).count() == 0


def test_folds_take_keys_of_any_type(spark):
    from pyspark.sql import functions as F

    from residuum.operators import windows as W

    rows = spark.range(3000).select((F.col("id") * 10).alias("n"), F.concat(F.lit("k"), F.col("id")).alias("s"))
    for key in ("n", "s"):
        sizes = [r["count"] for r in rows.groupBy(W.folds(key, 10)).count().collect()]
        assert len(sizes) == 10 and min(sizes) > 230


def test_tm_score_of_a_hinge():
    import numpy as np

    from residuum.operators import search

    rng = np.random.default_rng(2)
    p = np.cumsum(rng.normal(size=(60, 3)) * 2, 0)
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q = np.concatenate((p[:40], (p[40:] - p[40]) @ (turn * np.sign(np.linalg.det(turn))) + p[40] + 30))
    assert search.tm_score(p, q, 60) > 40 / 60 - 0.01  # two thirds fit exactly


def test_null_groups_stay(spark):
    rows = spark.createDataFrame([(None, 1, 1.0), (None, 2, 3.0), ("a", 1, 5.0), ("a", 2, None), (None, None, 4.0)], "g string, fold int, v double")
    assert curate.outliers(rows, "v", 1.0, ["g"]).count() == 5
    flagged = curate.outliers(rows.union(spark.createDataFrame([(None, 1, 900.0)], rows.schema)), "v", 1.2, ["g"])
    assert [r.v for r in flagged.filter("is_outlier").collect()] == [900.0]
    got = {(r.g, r.fold): r.oof for r in learn.out_of_fold_means(rows, ["g"], "fold", "v").collect()}
    assert got == {(None, 1): 3.5, (None, 2): 2.5, (None, None): 2.0, ("a", 1): None, ("a", 2): 5.0}
    assert curate.only_if_unique(rows, ["g", "fold"]).count() == 5
    assert curate.exclude(rows, rows.filter("g IS NULL AND fold = 1"), ["g", "fold"], ["v"]).filter("v IS NULL").count() == 2
    filled = W.fill_gaps(spark.createDataFrame([(None, 1, "x"), (None, 4, "y"), ("a", 2, "z")], "g string, n int, t string"), ["g"], "n")
    assert {(r.g, r.n, r.t) for r in filled.collect()} == {(None, 1, "x"), (None, 2, None), (None, 3, None), (None, 4, "y"), ("a", 2, "z")}
    marked = W.sections(rows.withColumn("t", F.lit("m here")), ["g"], "fold", "t", {"m": "m"})
    assert marked.count() == 5


def test_line_numbers_in_stretches(spark):
    places = [3, 9, 10, 11, 25, 10**12, 10**12 + 1, 7 * 10**12]
    rows = spark.createDataFrame([(f, p) for f in ("a", "b", None) for p in places[: 8 if f else 3]], "file string, pos long")
    got = sorted(((r.file or "", r.pos, r.n) for r in W.line_numbers(rows, ["file"], "pos", "n", width=10).collect()))
    assert got == sorted((f, p, k + 1) for f in ("a", "b", "") for k, p in enumerate(places[: 8 if f else 3]))
