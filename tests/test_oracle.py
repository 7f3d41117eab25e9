"""Every query against DuckDB SQL on the same tables."""

import datetime as dt
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from conftest import SF_DIR
from tallyloom.checks.oracle import all_oracle_sql
from tallyloom.checks.registry import all_queries

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
QUERIES = all_queries()
ORACLE = all_oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(
            f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(SF_DIR, name)}.parquet'"
        )
    yield con
    con.close()


def in_order(rows):
    """Highest cost first, within levels, days and before the total where there are such."""

    def key(row):
        return (
            getattr(row, "level", 0),
            getattr(row, "usage_date", dt.date.min),
            getattr(row, "is_total", False),
            -row.cost_usd,
        )

    return rows == sorted(rows, key=key)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    result = duck.execute(ORACLE[name])
    assert sorted(column[0] for column in result.description) == columns
    order = [[column[0] for column in result.description].index(c) for c in columns]
    wanted = sorted(repr(tuple(row[i] for i in order)) for row in result.fetchall())
    rows = frame.collect()
    assert sorted(repr(tuple(row[c] for c in columns)) for row in rows) == wanted
    assert rows
    by_time = name.startswith(("running_costs", "month_over_month", "sketched_years"))
    if "cost_usd" in columns and "preview" not in name and not by_time:
        assert in_order(rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(ORACLE) <= set(entry_module.oracle_sql())


def test_preview(spark):
    assert QUERIES["preview"](spark, SF_DIR).count() == 10


def test_entry(spark):
    frame = entry_module.entry(spark)
    assert frame.columns[0] == "resource_id" and frame.columns[-1] == "cost_usd"
    assert frame.count() == 4807
