"""Queries with SQL against DuckDB on the small tables."""

import duckdb
import pytest

from conftest import SF_DIR
from tallyloom.llm.registry import llm_oracle_sql, llm_queries


def test_one_query_for_each_operator():
    numbers = sorted(int(name.split("_")[0].removeprefix("op")) for name in llm_queries())
    assert numbers == list(range(1, 14))
    assert set(llm_oracle_sql()) <= set(llm_queries())


@pytest.mark.parametrize("name", sorted(llm_oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    frame = llm_queries()[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    result = con.execute(f"SELECT {', '.join(columns)} FROM ({llm_oracle_sql()[name]})")
    wanted = sorted(map(repr, result.fetchall()))
    assert sorted(repr(tuple(row[c] for c in columns)) for row in frame.collect()) == wanted
    assert wanted
