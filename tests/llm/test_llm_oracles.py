"""Queries with SQL against DuckDB on the smallest tables, and that all eleven are registered."""

import os

import duckdb
import pytest

from lodestack.llm import registry

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(registry.oracles()[name])
    columns = [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    assert want
    assert sorted(tuple(r) for r in registry.queries()[name](spark, SF).select(*columns).collect()) == want


def test_every_operator_and_the_pipeline_are_registered():
    names = set(registry.queries())
    assert all(len([n for n in names if n.startswith(f"op{k}_")]) == 1 for k in range(1, 11)) and "pipeline" in names and len(names) == 11
