"""Every pipeline stage on odd and on empty tables."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot long, __keep string, size int, item_id long, rejected_by string"
FINE = "plain words in a row that no rule rejects and no other document shares number {}"


def odd_rows():
    long = " ".join(f"word{k} again{k * 7}" for k in range(20_000))
    texts = [None, "", " \n\t ", FINE.format("one"), FINE.format("one"), long, "é ü ñ " + FINE.format("漢字"), FINE.format("two") + " \U0001f389"]
    rows = [(k, t, None if k % 2 else "en", None if k % 3 else "s", None, "x", None, "k", 1, None, None) for k, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, FINE.format("three"), None, None, None, None, None, None, None, None, None), (None,) * 11]


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)), ids=[name for name, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, tmp_path, k):
    name, stage = corpus_pipeline.STAGES[k]
    table = spark.createDataFrame(odd_rows(), SCHEMA)
    stage(spark, table, SF).write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    texts = {r.text for r in out.collect()}
    assert {FINE.format("one"), FINE.format("three")} <= texts or name == "mix_sources"
    assert sorted(out.columns) == sorted(table.columns)
    if name == "shard":
        assert out.count() == table.count()
    if name == "near_dedup":
        assert sum(r.text == FINE.format("one") for r in out.collect()) == 1


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)), ids=[name for name, _ in corpus_pipeline.STAGES])
def test_stage_on_nothing(spark, k):
    table = spark.createDataFrame([], SCHEMA)
    assert corpus_pipeline.STAGES[k][1](spark, table, SF).count() == 0
