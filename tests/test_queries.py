"""Registered queries vs their DuckDB oracle on the smallest test tables."""
import math

import duckdb
import pytest

import __spark_entry__ as entry
from civicflow.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 9)
    return str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_oracle_or_is_a_model():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(QUERIES) <= set(q) and set(o) <= set(q)
    assert set(QUERIES) - set(o) == {"severity_model", "complaint_classifier", "emotion_classifier"}


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & set(QUERIES)))
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    res = duck.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    si = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    di = sorted(range(len(dcols)), key=lambda i: dcols[i])
    key = lambda t: tuple((x is None, str(x)) for x in t)
    s = sorted((tuple(_norm(r[i]) for i in si) for r in rows), key=key)
    d = sorted((tuple(_norm(r[i]) for i in di) for r in res.fetchall()), key=key)
    assert s == d


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "branch" in df.columns
