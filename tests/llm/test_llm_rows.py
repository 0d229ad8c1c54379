"""Mixing, sharding, language and quality models, and the pipeline: laws, brute force, held-out accuracy, defined cases."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("residuum.llm")

from pyspark.sql import functions as F  # noqa: E402

from residuum.llm import langid, mixing, quality_model, sharding  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, size string, epochs string, target string"
SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    """rows: (doc_id, text, lang, source)."""
    return spark.createDataFrame([(*r, 0, "x", "y", "z", "t") for r in rows], DOCS)


# mixing


def brute_targets(sizes, weights=(5, 2, 1)):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(target.values())
        over = {s for s in free if left * w[s] / sum(w[x] for x in free) > 3 * sizes[s]}
        if not over:
            return target | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return target


def test_mix_follows_targets_and_repeats(spark):
    rng = np.random.default_rng(7)
    rows = [(k, "w " * int(rng.integers(0, 40)), "en", ("a", "b", "c", "d", None)[int(rng.choice(5, p=[0.04, 0.6, 0.16, 0.1, 0.1]))]) for k in range(900)]
    rows += [(3, rows[3][1], "en", rows[3][3])] * 2 + [(None, "x y", "en", "a"), (900, None, None, None), (901, "w " * 3000, "en", "b")]
    table = docs(spark, rows)
    plan = mixing.plan_mix(table).collect()
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(dict(sizes))
    taken, largest = defaultdict(int), max(len((t or "").split()) for _, t, _, _ in rows)
    assert sum(r.repeats for r in plan) == len(rows)
    for r in plan:
        assert 0 <= r.epochs <= 3 and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.part < r.repeats and r.epochs + (r.part > 0) <= 3
        taken[r.source] += r.size * (r.epochs * r.repeats + r.part)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * largest
    assert sum(taken.values()) <= sum(sizes.values())
    mixed = mixing.mix(table)
    assert mixed.columns == table.columns
    count = Counter((r.doc_id, r.source, r.text) for r in mixed.collect())
    assert sum(count.values()) == sum(r.epochs * r.repeats + r.part for r in plan)
    again = mixing.plan_mix(table.repartition(5)).collect()
    assert sorted(map(str, plan)) == sorted(map(str, again))


def one_by_one(rows):
    """Times each row is taken when every copy is queued by itself; rows: (id, source, size)."""
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    want, at, queue = brute_targets(dict(sizes)), defaultdict(int), []
    rank = {s: k for k, s in enumerate(sorted(sizes))}
    for epoch in range(3):
        for i, s, n in sorted(rows, key=lambda r: (rank[r[1]], hashlib.md5(f"mix-0:{r[0]}".encode()).hexdigest(), r[0], r[2])):
            at[s] += n
            queue.append((at[s] / want[s], rank[s], i, s, n))
    total, taken = 0, Counter()
    for _, _, i, s, n in sorted(queue):
        total += n
        if total > sum(sizes.values()):
            break
        taken[i, s, n] += 1
    return want, taken


@pytest.mark.parametrize("copies, size", [(3000, 3), (700, 11), (40, 400)])
def test_mix_takes_part_of_a_rows_copies(spark, copies, size):
    rows = [(7, "a", size)] * copies + [(100 + k, "a", 1 + k % 9) for k in range(600)] + [(5000 + k, "b", 1 + k % 7) for k in range(900)] + [(6000, "b", 2000)] * 2
    table = docs(spark, [(i, "w " * n, "en", s) for i, s, n in rows])
    want, taken = one_by_one(rows)
    plan = mixing.plan_mix(table).collect()
    assert {(r.id, r.source, r.size): r.epochs * r.repeats + r.part for r in plan if r.epochs or r.part} == dict(taken)
    for s in "ab":
        assert abs(sum(r.size * (r.epochs * r.repeats + r.part) for r in plan if r.source == s) - want[s]) <= max(n for *_, n in rows)
    count = Counter((r.doc_id, r.source, len(r.text) // 2) for r in mixing.mix(table).collect())
    assert count == taken
    assert Counter(r.id for r in mixing.dealt(mixing.plan_mix(table), chunk=64).collect()) == Counter(i for i, *_ in rows)


def test_mix_of_nothing_and_of_no_words(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [r.epochs for r in mixing.plan_mix(docs(spark, [(1, "", "en", "a"), (2, None, "en", "b")])).collect()] == [0, 0]


# sharding


def test_shards_are_exact_gapless_and_repeatable(spark):
    rows = [(k, f"t{k % 7}", "en", None) for k in range(1003)] + [(5, "t5", "en", None)] * 40 + [(None, None, None, None)] * 3
    table = docs(spark, rows)
    out = sharding.shuffle_into_shards(table, rows_a_task=60)
    assert out.columns == [c for c in table.columns if c != "shard"] + ["shard", "slot"]
    got = out.collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(map(len, slots.values())) == sorted(sharding.exact_sizes(len(rows), 16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
    again = sharding.shuffle_into_shards(table.repartition(7), rows_a_task=60).collect()
    assert sorted((r.shard, r.slot, str(r.doc_id)) for r in got) == sorted((r.shard, r.slot, str(r.doc_id)) for r in again)
    assert len({r.shard for r in got if r.doc_id == 5}) > 5  # copies are spread


def test_matrix_has_the_margins_and_the_law():
    held, sizes = [70, 0, 41, 9], [40, 40, 40]
    many = np.array([sharding.communication_matrix(held, sizes, seed) for seed in range(600)])
    assert (many.sum(2) == held).all() and (many.sum(1) == sizes).all()
    assert many[:, 0, 0].mean() == pytest.approx(70 / 3, abs=0.5)
    assert many[:, 0, 0].var() == pytest.approx(70 * (1 / 3) * (2 / 3) * (50 / 119), rel=0.2)


def exact_share(x, good, bad, n):
    """The hypergeometric probability as a fraction; n is small."""
    falling = lambda a, k: math.prod(range(a - k + 1, a + 1))
    return float(Fraction(math.comb(n, x) * falling(good, x) * falling(bad, n - x), falling(good + bad, n)))


def test_draws_beyond_a_billion_follow_the_law():
    good, bad = 3 * 10**9, 5 * 10**9
    for n in (1, 7, 60):
        assert [math.exp(sharding.log_share(x, good, bad, n)) for x in range(n + 1)] == pytest.approx([exact_share(x, good, bad, n) for x in range(n + 1)], rel=1e-10)
    for x in (0, 20, 37, 50):  # against exact integers where both kinds are small
        assert math.exp(sharding.log_share(x, 80, 120, 50)) == pytest.approx(math.comb(80, x) * math.comb(120, 50 - x) / math.comb(200, 50), rel=1e-12, abs=1e-300)
    rng = np.random.Generator(np.random.PCG64(3))
    many, want = 20_000, np.array([exact_share(x, good, bad, 12) for x in range(13)])
    got = np.bincount([sharding._draw(rng, good, bad, 12) for _ in range(many)], minlength=13)
    assert ((got - many * want) ** 2 / (many * want)).sum() < 40  # chi-squared of 12 degrees of freedom
    for good, bad, n in ((2 * 10**10, 10**9, 3 * 10**6), (5 * 10**9, 10**7, 2 * 10**9)):
        p, all_ = good / (good + bad), good + bad
        var = n * p * (1 - p) * (all_ - n) / (all_ - 1)
        x = np.array([sharding._draw(rng, good, bad, n) for _ in range(4_000)], float)
        assert abs(x.mean() - n * p) < 5 * (var / 4_000) ** 0.5 and x.var() == pytest.approx(var, rel=0.12)


def test_matrix_of_many_billions():
    held = [3 * 10**6] * 2000
    sizes = sharding.exact_sizes(sum(held), 16)
    matrix = np.array(sharding.communication_matrix(held, sizes, 1))
    assert (matrix.sum(1) == held).all() and (matrix.sum(0) == sizes).all() and matrix.min() > 180_000


def test_shards_of_maps_and_of_one_row_often(spark):
    rows = spark.range(300).select((F.col("id") % 3).alias("a"), F.create_map(F.lit("k"), F.col("id") % 2).alias("m"), F.lit("x").alias("slot"))
    got = sharding.shuffle_into_shards(rows.union(rows.limit(1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(900)))).drop("n")), shards=4, rows_a_task=50)
    assert got.columns == ["a", "m", "shard", "slot"]
    found = got.collect()
    assert sorted(Counter(r.shard for r in found).values()) == [300] * 4 and {str(r.m) for r in found} == {"{'k': 0}", "{'k': 1}"}
    assert all(sorted(r.slot for r in found if r.shard == s) == list(range(300)) for s in range(4))


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_rows(spark, n):
    got = sharding.shuffle_into_shards(docs(spark, [(k, None, None, None) for k in range(n)])).collect()
    assert sorted(r.shard for r in got) == list(range(n)) and all(r.slot == 0 for r in got)


# language


def test_languages_held_out(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs(spark, [(9001, None, "en", None), (9002, "", "en", None), (9003, "12 34 !!", "de", None), (None, "the thing", None, None)]).select(*table.columns)
    model = langid.fit(table.filter("doc_id % 3 <> 0"), table["text"], table["lang"])
    got = {r.id: r for r in langid.predict(table.union(odd), model).collect()}
    truth = {r.doc_id: r for r in table.collect()}
    held = [i for i in truth if i % 3 == 0 and len(truth[i].text) > 100]
    assert np.mean([got[i].lang_pred == truth[i].lang for i in held]) > 0.95
    assert [got[i].lang_pred for i in (9001, 9002, 9003)] == ["und"] * 3 and got[9001].score == 0
    assert got[None].lang_pred in model.languages and all(0 <= r.score <= 1 for r in got.values())


def test_copies_neither_shrink_nor_fill_the_sample(spark, monkeypatch):
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    copied = table.filter("lang IS NOT NULL").limit(1).withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(100_000)))).drop("__k")  # nine rows in ten
    rare = docs(spark, [(k, f"qqzz {k} xxqq vvq{k}", "zz", None) for k in range(40)]).select("doc_id", "text", "lang")
    seen, train = [], langid.train
    monkeypatch.setattr(langid, "train", lambda x, labels: seen.append(labels) or train(x, labels))
    known = table.filter("doc_id % 4 <> 2")
    model = langid.fit(known.unionByName(copied).unionByName(rare), F.col("text"), F.col("lang"))
    assert 2_000 < len(seen[0]) < 3_000 and Counter(seen[0])["zz"] == 40
    held = table.filter("doc_id % 4 = 2 AND length(text) > 50")
    got = {r.id: r.lang_pred for r in langid.predict(held, model).collect()}
    assert np.mean([got[r.doc_id] == r.lang for r in held.collect() if r.lang]) > 0.9


def test_language_of_a_very_long_text(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(table, table["text"], table["lang"])
    one = table.filter("length(text) > 500 AND lang IS NOT NULL").first()
    long = "1 " * 2_000_000 + one.text * 500  # judged by its end too
    got = langid.predict(docs(spark, [(1, one.text * 2000, None, None), (2, long, None, None)]), model).collect()
    assert got[0].lang_pred == one.lang and {r.id for r in got} == {1, 2} and all(0 <= r.score <= 1 for r in got)


def test_language_without_labels(spark):
    table = docs(spark, [(1, "hello", None, None)])
    model = langid.fit(table, table["text"], table["lang"])
    assert [r.lang_pred for r in langid.predict(table, model).collect()] == ["und"]
    assert langid.predict(docs(spark, []), model).count() == 0


# quality model


def test_quality_model_ranks_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    table, pages, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "pages", "labels"))
    told = labels.filter("doc_id % 2 = 0")
    got = {r.id: r for r in quality_model.classify(table, pages, told).collect()}
    assert len(got) == table.count()
    held = [(got[r.doc_id].score, r.quality) for r in labels.filter("doc_id % 2 = 1").collect()]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.9
    assert np.mean([got[r.doc_id].kept for r in labels.filter("quality = 1").collect()]) > 0.97


def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_exchange_goes_both_ways_and_helps():
    rng = np.random.default_rng(3)

    def rows(n):
        y = (rng.random(n) < 0.7).astype(float)
        return tuple(rng.normal(0, 1, (n, size)) * (np.arange(size) < 40) + 0.38 * (2 * y - 1)[:, None] * (np.arange(size) < 20) for size in (quality_model.CONTENT, quality_model.META)), y

    (xs, y), (pool, _), (held, told) = rows(160), rows(3000), rows(4000)
    found = {}
    for rounds in (0, 6):
        log = []
        model = quality_model.co_train(xs, y, pool, rounds=rounds, each=200, log=log)
        found[rounds] = [auc(model.logit(v, held[v]), told) for v in (0, 1)]
        if rounds:
            assert min(a for a, _ in log) == 0 or len(log) == rounds
            assert sum(a for a, _ in log) > 200 and sum(b for _, b in log) > 200, log
    assert all(after > before + 0.01 for before, after in zip(found[0], found[6])), found


def test_a_view_that_is_never_sure_of_bad_pages_hands_on_nothing():
    sure = np.r_[np.full(50, 0.99), np.full(50, 0.6)]
    assert quality_model.handed_on(sure, np.full(100, 0.5), {}, 0.8, 20) == {}
    both = np.r_[np.full(60, 0.99), np.full(3, 0.01), np.full(40, 0.5)]
    got = quality_model.handed_on(both, np.full(103, 0.5), {0: 1.0}, 0.8, 20)
    assert sum(got.values()) == 12 and len(got) == 15 and 0 not in got  # three bad ones allow twelve good ones
    assert 61 not in quality_model.handed_on(both, np.where(np.arange(103) == 61, 0.99, 0.5), {}, 0.8, 20)  # the other view is sure of the opposite


def test_quality_model_of_odd_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.b/en/1?x=1", ""), (2, None, None)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(1, 1, None), (1, None, 0)], "doc_id long, quality int, toxic int")
    table = docs(spark, [(1, None, None, None), (None, "x y", "en", "a"), (1, None, None, None)])
    got = quality_model.classify(table, pages, labels).collect()
    assert len(got) == 3 and all(r.kept and r.score > 0.9 for r in got)
    assert quality_model.classify(docs(spark, []), pages.limit(0), labels.limit(0)).count() == 0


# pipeline


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    table = spark.read.parquet(f"{SF}/documents.parquet")
    ids = [{r.doc_id for r in table.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        before = table
        stage(spark, table, SF).write.parquet(path)
        table = spark.read.parquet(path)
        ids.append({r.doc_id for r in table.select("doc_id").collect()})
        assert ids[-1] <= ids[-2]
        if name != "shard":
            assert table.columns == before.columns
    assert len(ids[3]) < len(ids[2]) < len(ids[0]) and table.count() > 0
    whole = {(r.doc_id, r.shard, r.slot) for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {(r.doc_id, r.shard, r.slot) for r in table.collect()}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from residuum.llm import common

    bare = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_folder(bare("spark://host:7077"))
    assert common.shared_folder(bare("local[2]")) == common.shared_folder(bare("local[4]"))


def test_running_sums_of_long_arrays(spark):
    from pyspark.sql import functions as F

    from residuum.llm.common import running_sums

    sizes = [0, 1, 63, 64, 65, 4096, 5000, 20_000]
    rows = spark.createDataFrame([(n,) for n in sizes], "n int").withColumn("a", F.transform(F.sequence(F.lit(0), "n"), lambda x: (x % 7).cast("bigint")))
    for r in rows.withColumn("s", running_sums(F.slice("a", F.lit(1), F.col("n")))).collect():
        assert r.s == list(__import__("itertools").accumulate(k % 7 for k in range(r.n)))
