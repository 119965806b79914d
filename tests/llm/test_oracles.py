"""Corpus queries that SQL can express equal their oracle on the smallest tables."""

import duckdb
import pytest

from loomspark.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = registry.queries()[name](spark, SF)
    found = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(columns).collect()))) == sorted(map(str, found.fetchall()))
