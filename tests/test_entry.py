"""Every registered query with SQL gives the rows that DuckDB gives for it, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from lexframe.plans import grounded, landing, retrieval, statutes

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = retrieval.QUERIES | statutes.QUERIES | grounded.QUERIES | landing.QUERIES

pytestmark = pytest.mark.skipif(not os.path.exists(f"{DATA}/documents.parquet"), reason="no test tables")


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        return f"{float(v):.6f}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and not hasattr(v, "__len__") else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def test_all_are_registered():
    assert set(CORE) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["qid", "doc_id", "score", "rank"]


@pytest.mark.parametrize("name", sorted(CORE))
def test_same_as_sql(spark, duck, name):
    got, want = CORE[name](spark, DATA).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
