"""The queries themselves: those with SQL against DuckDB, the others against their contracts, on the smallest tables."""

import re
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("residuum.llm")

from residuum.llm import common, queries, sharding  # noqa: E402

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="module")
def documents(tables):
    return dict(tables.sql("SELECT doc_id, text FROM documents").fetchall())


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: "none" if v is None or v is pd.NA or v != v else f"{float(v):.7g}" if isinstance(v, (int, float, np.number)) else str(v)
    return sorted(tuple(map(plain, r)) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_its_sql(spark, tables, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), tables.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_op6_contract(spark, tables):
    got = {r.doc_id: r for r in queries.op6_language_id(spark, SF).collect()}
    told = dict(tables.sql("SELECT doc_id, lang FROM documents").fetchall())
    assert set(got) == set(told)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.lang_pred in {*told.values(), "und"} for r in got.values())
    held = [r.lang_pred == told[i] for i, r in got.items() if r.held_out]
    assert np.mean(held) > 0.9


def test_op8_contract(spark, documents):
    got = queries.op8_shard(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(documents)
    for r in got:
        raw = (documents[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    sizes = [sorted(r.slot for r in got if r.shard == s) for s in range(16)]
    assert all(x == list(range(len(x))) for x in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1


def test_op9_contract(spark, documents):
    tokenizers = pytest.importorskip("tokenizers")
    plain, start = tokenizers.Tokenizer.from_file(queries.tokenizer_file()), 0
    got = {r.doc_id: r for r in queries.op9_token_output(spark, SF).collect()}
    for i in sorted(documents):
        ids = plain.encode(documents[i] or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op3_contract(spark, documents):
    from residuum.llm.simhash import fingerprint

    got = {r.doc_id: r for r in queries.op3_simhash(spark, SF).collect()}
    own = {i: fingerprint(t or "") for i, t in documents.items()}
    root = {i: i for i in own}
    links = [(a, b) for a in own for b in own if a < b and (own[a] ^ own[b]).bit_count() <= 3]
    for _ in own:
        moved = False
        for a, b in links:
            low = min(root[a], root[b])
            moved |= (root[a], root[b]) != (low, low)
            root[a] = root[b] = low
        if not moved:
            break
    assert {i: r.component_id for i, r in got.items()} == root
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) and int(r.fingerprint, 16) == own[i] for i, r in got.items())


def test_copies_of_one_row_are_spread(spark):
    table = spark.range(4000).selectExpr("CASE WHEN id < 3000 THEN 7 ELSE id END AS a", "'x' AS b").repartition(5)
    got = sharding.shuffle_into_shards(table, 16, rows_a_task=200).collect()
    sizes = [sorted(r.slot for r in got if r.shard == s) for s in range(16)]
    assert all(x == list(range(250)) for x in sizes)
    assert sorted(r.a for r in got) == sorted([7] * 3000 + list(range(3000, 4000)))
    share = [sum(r.a == 7 for r in got if r.shard == s) for s in range(16)]
    assert min(share) > 150 and max(share) < 225  # 187.5 on average
    again = sharding.shuffle_into_shards(table.repartition(3), 16, rows_a_task=200).collect()
    assert sorted(got) == sorted(again)


def test_the_pipeline_leaves_only_what_is_still_read(spark, tmp_path):
    import corpus_pipeline

    before = set(common._made)
    out = corpus_pipeline.run(spark, SF)
    left = [p for p in common._made if p not in before]
    assert sum("stage-" in p for p in left) == 1 and "stage-mix_sources" in [p for p in left if "stage-" in p][0]
    assert not [p for p in left if "links" in p or "signatures" in p or "item-windows" in p]
    assert out.count() > 0
