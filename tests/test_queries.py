"""Every query of the library against DuckDB on the smallest tables; those without SQL must give rows."""

from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__
from residuum.plans import positional, registry, structures, tabular  # noqa: F401

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    plain = lambda v: "null" if pd.isna(v) else f"{float(v):.7g}" if isinstance(v, (int, float)) else str(v)
    return sorted(tuple(map(plain, r)) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, tables, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.SQL:
        assert len(got) > 0
        return
    want = tables.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
