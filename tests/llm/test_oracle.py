"""The operators' queries against their DuckDB SQL on the smallest test tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from civicflow.llm.registry import LLM_ORACLE_SQL, LLM_QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings")


def test_all_operators_are_registered():
    assert {n.split("_")[0] for n in LLM_QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert {*LLM_QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(LLM_ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = entry.queries()[name](spark, SF)
    res = con.execute(LLM_ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted(map(str, (tuple(r) for r in got.select(*names).collect())))
    assert rows == sorted(map(str, res.fetchall())) and rows
