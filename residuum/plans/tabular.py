"""Queries on orders, lines, customers, parts and events: errors, curation, lookups, transfer, folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from residuum.functions import label_text as L
from residuum.functions import rules as R
from residuum.operators import curate, evaluate, learn, local_search, transfer, trees
from residuum.operators import windows as W
from residuum.plans.registry import query
from residuum.sources import tables


@query("""
SELECT l_returnflag, count(*) AS n, round(sqrt(avg((l_quantity * 1000 - l_extendedprice) * (l_quantity * 1000 - l_extendedprice))), 6) AS rmse,
       min(abs(l_quantity * 1000 - l_extendedprice)) AS min_abs, max(abs(l_quantity * 1000 - l_extendedprice)) AS max_abs,
       round(corr(l_quantity * 1000, l_extendedprice), 8) AS r
FROM lineitem GROUP BY l_returnflag""")
def error_table(t):
    out = evaluate.errors(t("lineitem"), F.col("l_quantity") * 1000, F.col("l_extendedprice"), ["l_returnflag"])
    return out.withColumn("rmse", F.round("rmse", 6)).withColumn("r", F.round("r", 8))


@query("""
WITH long AS (
  SELECT 'base' AS model, l_extendedprice AS pred, l_quantity * 1000 AS real FROM lineitem
  UNION ALL SELECT 'discounted', l_extendedprice * (1 - l_discount), l_quantity * 1000 FROM lineitem
  UNION ALL SELECT 'charged', l_extendedprice * (1 + l_tax), l_quantity * 1000 FROM lineitem)
SELECT model, count(*) AS n, round(sqrt(avg((pred - real) * (pred - real))), 5) AS rmse, round(min(abs(pred - real)), 6) AS min_abs,
       round(max(abs(pred - real)), 6) AS max_abs, round(corr(pred, real), 8) AS r
FROM long GROUP BY model""")
def error_global_unpivot(t):
    price = F.col("l_extendedprice")
    measures = {"base": price, "discounted": price * (1 - F.col("l_discount")), "charged": price * (1 + F.col("l_tax"))}
    long = evaluate.long_form(t("lineitem"), ["l_quantity"], measures)
    out = evaluate.errors(long, F.col("pred"), F.col("l_quantity") * 1000, ["model"])
    return out.withColumns({"rmse": F.round("rmse", 5), "min_abs": F.round("min_abs", 6), "max_abs": F.round("max_abs", 6), "r": F.round("r", 8)})


@query("""
SELECT p_partkey, round(CASE WHEN x > 0 THEN pow(x, -1) ELSE 0 END, 10) AS size_m1, round(CASE WHEN x > 0 THEN pow(x, -2) ELSE 0 END, 10) AS size_m2,
       round(CASE WHEN x > 0 THEN pow(x, -3) ELSE 0 END, 10) AS size_m3, x * x AS size_2
FROM (SELECT p_partkey, CAST(p_size % 7 AS DOUBLE) AS x FROM part)""")
def power_features(t):
    x = (F.col("p_size") % 7).cast("double")
    return t("part").select("p_partkey", *[F.round(R.power(x, -p), 10).alias(f"size_m{p}") for p in (1, 2, 3)], R.power(x, 2).alias("size_2"))


@query("""
SELECT o_orderkey, round(o_totalprice - coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0), 4) AS less_filled,
       round(o_totalprice - CASE WHEN c_acctbal > 0 THEN c_acctbal END, 4) AS less_required
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def diff_baseline(t):
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    base = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    price = F.col("o_totalprice")
    return joined.select("o_orderkey", F.round(R.less_baselines(price, filled=[base]), 4).alias("less_filled"), F.round(R.less_baselines(price, required=[base]), 4).alias("less_required"))


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("SELECT c_custkey, " + ", ".join(f"CAST(coalesce(c_mktsegment = '{s}', false) AS INTEGER) AS is_{s}" for s in SEGMENTS) + " FROM customer")
def onehot_segment(t):
    return t("customer").select("c_custkey", *R.one_hot(F.col("c_mktsegment"), SEGMENTS, "is_"))


@query("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def lookup_scalar(t):
    nations = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")  # 5 and 25 rows
    return t("supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name", "r_name")


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, nullif(l_discount, 0) AS a, nullif(l_tax, 0) AS b, l_quantity AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(coalesce((a + b) / 2, a, b, q), 6) AS merged FROM x""")
def merge_alternates(t):
    a, b = F.nullif(F.col("l_discount"), F.lit(0.0)), F.nullif(F.col("l_tax"), F.lit(0.0))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(R.merge_alternates(a, b, F.col("l_quantity")), 6).alias("merged"))


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice >= 1000 THEN o_totalprice END AS above, CASE WHEN o_totalprice <= 200000 THEN o_totalprice END AS below FROM orders""")
def range_nullout(t):
    price = F.col("o_totalprice")
    return t("orders").select("o_orderkey", R.null_below(price, 1000.0).alias("above"), R.null_above(price, 200000.0).alias("below"))


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CAST(l_returnflag = 'R' AS INTEGER) AS f1, CAST(l_linestatus = 'F' AS INTEGER) AS f2,
                  cos(l_discount) AS c, sin(l_discount) AS s, cos(l_tax) AS c2 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN f1 + f2 > 0 THEN l_quantity END AS flagged,
       CASE WHEN (c = 0 AND s = 0) OR abs(c - c2) = 1 OR abs(c - c2) <= 0.001 THEN l_quantity END AS agreeing FROM x""")
def flag_purifier(t):
    flags = [(F.col("l_returnflag") == "R").cast("int"), (F.col("l_linestatus") == "F").cast("int")]
    quantity, d, x = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", R.null_if_all_zero(quantity, flags).alias("flagged"), R.null_if_angles_differ(quantity, F.cos(d), F.sin(d), F.cos(x)).alias("agreeing"))


@query("""
WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events)
SELECT event_id, value, abs(value - m) > 5 * sd AS is_outlier FROM events, s""")
def outlier_sigma(t):
    return curate.outliers(t("events").select("event_id", "value"), "value", 5.0)


@query("""
WITH s AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY event_type)
SELECT event_id, value, event_type, abs(value - m) > 3 * sd AS is_outlier FROM events JOIN s USING (event_type)""")
def outlier_sigma_by_group(t):
    return curate.outliers(t("events").select("event_id", "value", "event_type"), "value", 3.0, ["event_type"])


@query("""
WITH m AS (SELECT median(CASE WHEN l_discount <> 0 THEN l_discount END) AS d, median(CASE WHEN l_tax <> 0 THEN l_tax END) AS x FROM lineitem WHERE l_orderkey % 2 = 0)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount = 0 THEN d ELSE l_discount END AS l_discount, CASE WHEN l_tax = 0 THEN x ELSE l_tax END AS l_tax
FROM lineitem, m WHERE l_orderkey % 2 = 1""")
def median_impute(t):
    lines = t("lineitem")
    fitted = curate.medians(lines.filter("l_orderkey % 2 = 0"), ["l_discount", "l_tax"])
    rest = lines.filter("l_orderkey % 2 = 1").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax")
    return curate.impute(rest, fitted)


@query("""
SELECT d.doc_id, d.lang, CASE WHEN l.doc_id IS NULL THEN d.n_chars END AS n_chars
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) l ON d.doc_id = l.doc_id""")
def exclusion_list(t):
    docs = t("documents").select("doc_id", "lang", "n_chars")
    return curate.exclude(docs, t("labels").filter("toxic = 1"), ["doc_id"], ["n_chars"])


@query("""
SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def anti_residues(t):
    return t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("""
SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def semi_residues(t):
    returned = t("lineitem").filter("l_returnflag = 'R'")
    return t("orders").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


def _daily(t):
    events = t("events").withColumn("day", F.datediff("ts", F.lit("1970-01-01").cast("date")))
    return events.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"))


_DAILY = "SELECT user_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS day, count(*) AS n FROM events GROUP BY ALL"


@query(f"""
WITH d AS ({_DAILY})
SELECT user_id, day, n, CASE WHEN lag(day) OVER w = day - 1 THEN lag(n) OVER w ELSE 0 END AS n_im1, CASE WHEN lead(day) OVER w = day + 1 THEN lead(n) OVER w ELSE 0 END AS n_ip1
FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)""")
def neighbor_guarded(t):
    return W.guarded(_daily(t), ["user_id"], "day", {"n": 0})


@query(f"""
WITH d AS ({_DAILY}), s AS (SELECT user_id, min(day) AS a, max(day) AS b FROM d GROUP BY user_id),
e AS (SELECT user_id, CAST(unnest(generate_series(a, b)) AS INTEGER) AS day FROM s)
SELECT e.user_id, e.day, d.n FROM e LEFT JOIN d ON e.user_id = d.user_id AND e.day = d.day""")
def gap_fill(t):
    return W.fill_gaps(_daily(t), ["user_id"], "day")


@query("""
SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ordinal FROM events""")
def prefix_ordinal(t):
    return W.ordinal(t("events").select("event_id", "user_id", "event_type"), ["user_id"], ["event_id"], F.col("event_type") == "click").drop("event_type")


@query("""
WITH g AS (SELECT event_id, user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR AS b FROM events)
SELECT event_id, user_id, CAST(sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM g""")
def break_segments(t):
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts")) > F.expr("INTERVAL 6 HOURS")
    events = t("events").select("event_id", "user_id", "ts").withColumn("gap", gap)
    return W.segments(events, ["user_id"], ["ts"], F.col("gap")).select("event_id", "user_id", "segment")


@query("SELECT user_id, event_type, arg_max(value, ts) AS value FROM events GROUP BY user_id, event_type")
def last_write_wins(t):
    return curate.last_wins(t("events"), ["user_id", "event_type"], "value", "ts")


@query("SELECT user_id, event_type, arg_min(event_id, ts) AS event_id, arg_min(value, ts) AS value FROM events GROUP BY user_id, event_type")
def first_write_wins(t):
    return curate.first_wins(t("events"), ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id", "value")


KINDS = ("click", "purchase", "view")


@query("SELECT user_id, " + ", ".join(f"max(value) FILTER (event_type = '{k}') AS {k}" for k in KINDS) + " FROM events GROUP BY user_id")
def pivot_labels(t):
    return curate.pivot_labels(t("events"), ["user_id"], "event_type", "value", KINDS)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_prop(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""
SELECT p_partkey, regexp_replace(regexp_replace(trim(p_brand), '^(\\d)(.*)$', '\\2\\1'), '^D', 'H') AS atom,
       CASE WHEN length(p_type) > 3 THEN substr(p_type, 2) ELSE p_type END AS short,
       CASE upper(substr(p_name, 1, 1)) WHEN 'A' THEN 'ALA' WHEN 'R' THEN 'ARG' WHEN 'N' THEN 'ASN' WHEN 'D' THEN 'ASP' WHEN 'C' THEN 'CYS' WHEN 'Q' THEN 'GLN'
         WHEN 'E' THEN 'GLU' WHEN 'G' THEN 'GLY' WHEN 'H' THEN 'HIS' WHEN 'I' THEN 'ILE' WHEN 'L' THEN 'LEU' WHEN 'K' THEN 'LYS' WHEN 'M' THEN 'MET' WHEN 'F' THEN 'PHE'
         WHEN 'P' THEN 'PRO' WHEN 'S' THEN 'SER' WHEN 'T' THEN 'THR' WHEN 'W' THEN 'TRP' WHEN 'Y' THEN 'TYR' WHEN 'V' THEN 'VAL' ELSE 'UNK' END AS code
FROM part""")
def code_normalise(t):
    return t("part").select("p_partkey", L.atom_name(F.col("p_brand")).alias("atom"), L.residue_name(F.col("p_type")).alias("short"), L.three_letters(F.upper(F.substring("p_name", 1, 1))).alias("code"))


@query("""
WITH p AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b, a.n_nationkey * 31 + b.n_nationkey AS score FROM nation a JOIN nation b ON a.n_nationkey <= b.n_nationkey),
s AS (SELECT a, b, score FROM p UNION ALL SELECT b, a, score FROM p WHERE a <> b)
SELECT o_orderkey, l_suppkey, l_partkey, l_linenumber, c_nationkey, s_nationkey, score
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN s ON s.a = c_nationkey AND s.b = s_nationkey""")
def pair_lookup_sym(t):
    keys = t("nation").select(F.col("n_nationkey").alias("a"))
    last = F.lit(24)  # nations are numbered from 0
    half = keys.withColumn("b", F.explode(F.sequence("a", last))).withColumn("score", F.col("a") * 31 + F.col("b"))
    table = transfer.symmetric(half)
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.join(F.broadcast(table), (F.col("a") == F.col("c_nationkey")) & (F.col("b") == F.col("s_nationkey"))).select("o_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "c_nationkey", "s_nationkey", "score")  # 625 rows


@query("SELECT l_orderkey, round(avg(l_quantity), 6) AS mean_all, round(sum(l_quantity) FILTER (l_linenumber <= 6) / 6, 6) AS mean_six FROM lineitem GROUP BY l_orderkey")
def mean_bfactor(t):
    six = F.sum(F.when(F.col("l_linenumber") <= 6, F.col("l_quantity"))) / 6
    return t("lineitem").groupBy("l_orderkey").agg(F.round(F.avg("l_quantity"), 6).alias("mean_all"), F.round(six, 6).alias("mean_six"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice / max(l_extendedprice) OVER (PARTITION BY l_orderkey), 9) AS share FROM lineitem")
def normalised_score(t):
    out = transfer.share_of_best(t("lineitem"), ["l_orderkey"], "l_extendedprice", "share")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("share", 9).alias("share"))


@query("""
WITH x AS (SELECT o_custkey, o_totalprice / 100000 - 1 AS v, exp(5 * (o_orderkey % 10) / 10.0) * exp(length(o_orderpriority) / 10.0) AS w FROM orders)
SELECT o_custkey, round(greatest(-0.5, least(0.5, sum(w * v) / sum(w))), 7) AS value FROM x GROUP BY o_custkey""")
def weighted_transfer(t):
    orders = t("orders").withColumn("v", F.col("o_totalprice") / 100000 - 1)
    weight = R.softmax_weight((F.col("o_orderkey") % 10) / F.lit(10.0), F.length("o_orderpriority") / F.lit(10.0))
    return transfer.weighted_mean(orders, ["o_custkey"], "v", weight, 0.5).withColumn("value", F.round("value", 7))


@query("""
SELECT o_custkey, o_orderkey, score FROM (
  SELECT o_custkey, o_orderkey, floor(o_totalprice / 50000) AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 50000) DESC, o_orderkey) AS k FROM orders)
WHERE k = 1""")
def best_reference(t):
    orders = t("orders").withColumn("score", F.floor(F.col("o_totalprice") / 50000).cast("double"))
    return transfer.best_reference(orders, ["o_custkey"], F.col("score"), "o_orderkey").select("o_custkey", "o_orderkey", "score")


@query("""
SELECT c_custkey, round(avg(o_totalprice), 6) AS value, coalesce(round(max(o_totalprice), 6), 0) AS score FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def no_hit_default(t):
    found = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.avg("o_totalprice"), 6).alias("value"), F.round(F.max("o_totalprice"), 6).alias("score"))
    return transfer.or_default(t("customer").select("c_custkey"), found, ["c_custkey"], ["score"])


@query("""
SELECT l_returnflag, count(*) FILTER (l_returnflag = l_linestatus) AS strict0, count(*) FILTER (l_discount - 0.05 > 0) AS strict1, count(*) AS strict2 FROM lineitem GROUP BY l_returnflag""")
def strictness_modes(t):
    same, similar = F.col("l_returnflag") == F.col("l_linestatus"), F.col("l_discount") - 0.05
    return t("lineitem").groupBy("l_returnflag").agg(*[F.count_if(transfer.transferable(k, same, similar)).alias(f"strict{k}") for k in range(3)])


@query("""
WITH h AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS score, pow(10, -CAST(l_suppkey % 20 AS DOUBLE)) AS evalue, CAST(floor(l_extendedprice) AS BIGINT) % 60 AS lm, CAST(l_quantity AS BIGINT) * 2 AS tm FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(lm / greatest(tm, 30), 9) AS coverage FROM h
WHERE score >= 0 AND evalue <= 1e-10 AND ((tm >= 40 AND lm / tm >= 0.15) OR (tm >= 20 AND lm / tm >= 0.4)) AND lm / greatest(tm, 30) <= 0.99""")
def hit_filter(t):
    lines = t("lineitem")
    hits = lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").alias("score"), F.pow(F.lit(10.0), -(F.col("l_suppkey") % 20).cast("double")).alias("evalue"), (F.floor("l_extendedprice") % 60).alias("lmatch"), (F.col("l_quantity").cast("long") * 2).alias("tmatch"))
    hits = hits.withColumn("coverage", R.coverage(F.col("lmatch"), F.col("tmatch"), F.lit(30)))
    return transfer.sequence_hits(hits, exclude_self=True).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("coverage", 9).alias("coverage"))


@query("SELECT p_partkey, levenshtein(p_name, p_type) AS distance FROM part")
def edit_distance(t):
    return t("part").select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("distance"))


@query("""
WITH x AS (SELECT event_id, event_type, value, CAST(CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 AS INTEGER) AS fold FROM events),
f AS (SELECT event_type, fold, sum(value) AS s, count(value) AS n FROM x GROUP BY event_type, fold),
a AS (SELECT event_type, sum(s) AS s, sum(n) AS n FROM f GROUP BY event_type)
SELECT x.event_id, x.fold, round((a.s - f.s) / (a.n - f.n), 6) AS oof FROM x JOIN f USING (event_type, fold) JOIN a USING (event_type)""")
def kfold_oof(t):
    events = t("events").select("event_id", "event_type", "value", W.folds("event_id", 10).alias("fold"))
    return learn.out_of_fold_means(events, ["event_type"], "fold", "value").select("event_id", "fold", F.round("oof", 6).alias("oof"))


@query("""
WITH x AS (SELECT event_id, event_type, value, CAST(CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 AS INTEGER) AS fold, user_id FROM events),
f AS (SELECT event_type, fold, sum(value) AS s, count(value) AS n FROM x GROUP BY event_type, fold),
a AS (SELECT event_type, sum(s) AS s, sum(n) AS n FROM f GROUP BY event_type)
SELECT x.event_id, round(coalesce(CASE WHEN user_id % 3 = 0 THEN value * 0.5 END, (a.s - f.s) / (a.n - f.n)) + length(event_type), 6) AS final
FROM x JOIN f USING (event_type, fold) JOIN a USING (event_type)""")
def stack_fallback(t):
    events = t("events").select("event_id", "event_type", "value", "user_id", W.folds("event_id", 10).alias("fold"))
    out = learn.out_of_fold_means(events, ["event_type"], "fold", "value")
    final = learn.fallback(F.col("user_id") % 3 == 0, F.col("value") * 0.5, F.col("oof"), F.length("event_type"))
    return out.select("event_id", F.round(final, 6).alias("final"))


@query("""
SELECT o_custkey AS custkey, o_orderkey AS orderkey, CAST(NULL AS VARCHAR) AS name FROM orders UNION ALL SELECT c_custkey, NULL, c_name FROM customer""")
def union_by_name(t):
    orders = t("orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"))
    return tables.union([orders, t("customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("custkey"))])


@query("""
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) = 1)""")
def count_guard(t):
    return curate.only_if_unique(t("orders").select("o_orderkey", "o_custkey"), ["o_custkey"])


@query("""
SELECT l_returnflag, count(l_quantity) AS count, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS min,
       quantile_cont(l_quantity, 0.25) AS q25, quantile_cont(l_quantity, 0.5) AS q50, quantile_cont(l_quantity, 0.75) AS q75, max(l_quantity) AS max
FROM lineitem GROUP BY l_returnflag""")
def describe(t):
    out = curate.describe(t("lineitem"), "l_quantity", ["l_returnflag"])
    return out.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("SELECT CAST(least(10, floor(l_quantity / 5)) + 1 AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram(t):
    return curate.histogram(t("lineitem"), "l_quantity", 0.0, 50.0, 10)


@query("""
WITH s AS (SELECT avg(l_quantity) AS m1, stddev_samp(l_quantity) AS s1, avg(l_extendedprice) AS m2, stddev_samp(l_extendedprice) AS s2 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity - m1) / s1, 6) AS l_quantity, round((l_extendedprice - m2) / s2, 6) AS l_extendedprice FROM lineitem, s""")
def whiten(t):
    names = ["l_quantity", "l_extendedprice"]
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *names)
    return curate.whiten(rows, names).withColumns({n: F.round(n, 6) for n in names})


@query()
def forest_fit_predict(t):
    """Rows only: trees have no SQL. Each fold is predicted by trees that haven't seen it; all are grown together."""
    rows = t("events").select("event_id", F.col("user_id").cast("double").alias("user"), F.hour("ts").cast("double").alias("hour"), F.length("event_type").cast("double").alias("kind"), "value", W.folds("event_id", 3).alias("fold"))
    names = ["user", "hour", "kind"]
    grown = trees.fit(rows, names, "value", trees=8, subset=0.7, leaf=3, split=15, depth=6, fold="fold", folds=3)
    return trees.predict(rows, grown, "prediction", "fold").select("event_id", "prediction")


@query()
def stacked_models(t):
    """Rows only. Both levels: trees out of fold, a forest on top of them, and one more with a transferred value where there is one."""
    rows = t("events").select("event_id", F.col("user_id").cast("double").alias("user"), F.hour("ts").cast("double").alias("hour"), "value", F.when(F.col("user_id") % 2 == 0, F.col("value") + F.col("user_id") % 7).alias("moved"), W.folds("event_id", 3).alias("fold"))
    models = learn.stack(rows, ["user", "hour"], "value", "fold", 3, ["moved"], trees=4, depth=5)
    out = trees.predict(rows, models["r0"], "r0_pred", "fold")
    for name, inputs in (("r1", ["user", "hour", "r0_pred"]), ("r2", ["user", "hour", "filled", "r0_pred"])):
        ready = learn.assembled(out.withColumn("filled", F.coalesce("moved", F.lit(0.0))), inputs)
        out = models[name].transform(ready).withColumnRenamed("pred", f"{name}_pred").drop("features", "filled")
    final = learn.fallback(F.col("moved").isNotNull(), F.col("r2_pred"), F.col("r1_pred"), F.lit(0.0))
    return out.select("event_id", "r0_pred", "r1_pred", final.alias("final"))


_ACIDS = "ARNDCQEGHILKMFPSTWYV"
_PUT = f"'abcdefghijklmnopqrstuvwxyz ', '{(_ACIDS * 2)[:26]}'"
#: Identity, a likeness by rule, and the rest.
_LIKE = [[4 if a == b else 1 if (a + b + 2) % 3 == 0 else -3 for b in range(21)] for a in range(21)]


def _names(t, key):
    """Names of parts as sequences of twenty letters."""
    return t("part").select(F.col("p_partkey").alias(key), F.translate("p_name", "abcdefghijklmnopqrstuvwxyz ", (_ACIDS * 2)[:26]).alias("sequence"))


def _sql_score(k):
    a, b = f"strpos('{_ACIDS}', a.w[{k}])", f"strpos('{_ACIDS}', b.w[{k}])"
    return f"CASE WHEN {a} = {b} THEN 4 WHEN ({a} + {b}) % 3 = 0 THEN 1 ELSE -3 END"


@query(f"""
WITH s AS (SELECT p_partkey AS id, translate(p_name, {_PUT}) AS s FROM part),
w AS (SELECT id, i, s[i + 1 : i + 3] AS w FROM (SELECT id, s, unnest(range(length(s) - 2)) AS i FROM s)),
near AS (SELECT a.w AS a, b.w AS b FROM (SELECT DISTINCT w FROM w WHERE id % 100 = 0) a, (SELECT DISTINCT w FROM w) b WHERE {" + ".join(map(_sql_score, (1, 2, 3)))} >= 9),
hit AS (SELECT q.id AS query, t.id AS target, q.i AS pos, t.i - q.i AS diagonal FROM w q JOIN near ON q.w = near.a JOIN w t ON t.w = near.b WHERE q.id % 100 = 0),
two AS (SELECT *, count(*) OVER (PARTITION BY query, target, diagonal ORDER BY pos RANGE BETWEEN 40 PRECEDING AND 3 PRECEDING) AS n FROM hit)
SELECT query, target, CAST(pos AS INTEGER) AS pos, CAST(diagonal AS INTEGER) AS diagonal FROM two WHERE n > 0""")
def diagonal_hits(t):
    """Where every hundredth name meets all names: words that score 9 against each other, two of them near each other on a diagonal."""
    queries = _names(t, "query").filter("query % 100 = 0")
    near = local_search.neighbours(queries.sparkSession, _LIKE, _ACIDS, 3, 9)
    return local_search.diagonals(queries, _names(t, "target"), near, 3, _ACIDS, 40)


@query()
def ranked_segments(t):
    """Rows only: every hundredth name searched among all, segments by E-value."""
    found = local_search.search(_names(t, "query").filter("query % 100 = 0"), _names(t, "target"), _LIKE, _ACIDS, 3, 9)
    return found.select("query", "target", "diagonal", "begin", "end", "score", F.round("bits", 6).alias("bits"), F.round("expected", 9).alias("expected"), "rank")


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, nullif(l_quantity, 7) AS q, nullif(l_discount, 0.05) AS d FROM lineitem),
m AS (SELECT median(q) AS mq, median(d) AS md FROM t WHERE l_orderkey % 2 = 0)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(coalesce(q, mq), 6) AS q, round(coalesce(d, md), 6) AS d FROM t, m""")
def null_impute(t):
    """Nulls become medians of the training rows, those of even orders."""
    rows = t("lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.nullif(F.col("l_quantity"), F.lit(7.0)).alias("q"), F.nullif(F.col("l_discount"), F.lit(0.05)).alias("d"))
    fitted = curate.medians(rows.filter("l_orderkey % 2 = 0"), ["q", "d"], skip_zero=False)
    return curate.impute(rows, fitted, zero=False).withColumns({c: F.round(c, 6) for c in ("q", "d")})


@query("""
SELECT p_partkey, array_to_string(flatten(list_transform(string_split(p_brand, ''), lambda c: list_transform(string_split('0123456789', ''), lambda x: CAST(x = c AS INTEGER)))), '') AS bits FROM part""")
def sequence_onehot(t):
    hot = R.sequence_one_hot(F.col("p_brand"), "0123456789")
    return t("part").select("p_partkey", F.array_join(F.transform(F.flatten(hot), lambda x: x.cast("string")), "").alias("bits"))


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_discount = 0 THEN nullif(l_tax, 0) ELSE l_discount END AS fixed,
       coalesce(l_quantity < 5 OR l_quantity > 45, false) AS outside
FROM lineitem WHERE round(cos(l_quantity), 9) = 0 OR cos(l_quantity) < cos(radians(120.0))""")
def bond_filter(t):
    rows = t("lineitem").filter((F.round(F.cos("l_quantity"), 9) == 0) | R.bond_angle_ok(F.cos("l_quantity"), 60.0))
    fixed = R.zero_to(F.col("l_discount"), F.nullif(F.col("l_tax"), F.lit(0.0)))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", fixed.alias("fixed"), R.outside(F.col("l_quantity"), 5.0, 45.0).alias("outside"))


@query("""
WITH x AS (SELECT user_id, event_id, event_type AS f, lag(event_type, 1, '-') OVER (PARTITION BY user_id ORDER BY event_id) AS l FROM events),
s AS (SELECT *, f = l AND f <> '-' AS same, CAST(sum(CASE WHEN f <> '-' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS feature_no,
             CAST(sum(CASE WHEN l <> '-' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS label_no FROM x WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
o AS (SELECT *, same AND coalesce(lag(same) OVER w, true) AND coalesce(lead(same) OVER w, true) AS ok FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, feature_no, label_no FROM o WHERE ok""")
def alignment_join(t):
    before = F.lag("event_type", 1, "-").over(Window.partitionBy("user_id").orderBy("event_id"))
    pairs = t("events").select("user_id", F.col("event_id").alias("pos"), F.col("event_type").alias("feature_res"), before.alias("label_res"))
    return transfer.labels_by_alignment(pairs, ["user_id"])


@query("""
SELECT c_custkey, round(c_acctbal / 1000 - c_nationkey, 6) AS secondary, round(c_acctbal / 1000 - c_nationkey + c_nationkey, 6) AS full_value FROM customer""")
def secondary_flag(t):
    value, coil = F.col("c_acctbal") / 1000 - F.col("c_nationkey"), F.col("c_nationkey")
    return t("customer").select("c_custkey", F.round(R.observed(value, coil, True), 6).alias("secondary"), F.round(R.observed(value, coil, False), 6).alias("full_value"))


@query("SELECT o_orderkey, CAST((o_totalprice > 0) AS INTEGER) + CAST((o_orderpriority <> '') AS INTEGER) + CAST((nullif(o_orderstatus, 'O') IS NOT NULL) AS INTEGER) AS present FROM orders")
def labels_present(t):
    each = F.array(F.when(F.col("o_totalprice") > 0, 1), F.when(F.col("o_orderpriority") != "", 1), F.when(F.col("o_orderstatus") != "O", 1))
    return t("orders").select("o_orderkey", F.size(F.filter(each, lambda x: x.isNotNull())).alias("present"))
