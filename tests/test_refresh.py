"""Loading months: whole once, whatever a load is broken off in."""

import os
import shutil

import pytest
from pyspark.sql.readwriter import DataFrameWriter

from bills import BILL, bill
from tallyloom.sources import refresh
from tallyloom.sources.bill import read_bill
from tallyloom.sources.refresh import (
    finish_loads,
    loads,
    publish_load,
    refresh_months,
    stage_load,
)

MAY, JUNE = "2026-05", "2026-06"


def lines(spark, month, *costs):
    return bill(spark, *({"period": month, "resource": "r", "cost": cost} for cost in costs))


def costs(spark, path):
    rows = read_bill(spark, path, BILL).collect()
    return sorted((row.billing_period, row.line_item_unblended_cost) for row in rows)


def files(path, month):
    folder = f"{path}/BILLING_PERIOD={month}"
    return {name: os.stat(f"{folder}/{name}").st_mtime_ns for name in os.listdir(folder)}


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "bill")
    both = lines(spark, MAY, 1.0, 2.0).unionAll(lines(spark, JUNE, 3.0))
    assert refresh_months(spark, both, path, "1", BILL)
    return path


def test_a_month_is_replaced_and_others_are_not_touched(spark, stored):
    before = files(stored, MAY)
    assert refresh_months(spark, lines(spark, JUNE, 4.0, 5.0), stored, "2", BILL)
    assert costs(spark, stored) == [(MAY, 1.0), (MAY, 2.0), (JUNE, 4.0), (JUNE, 5.0)]
    assert files(stored, MAY) == before
    found = [(row.load_id, row.billing_period, row.raw_line_items, float(row.cost), row.finished) for row in loads(spark, stored).collect()]
    assert found == [("1", MAY, 2, 3.0, True), ("1", JUNE, 1, 3.0, True), ("2", JUNE, 2, 9.0, True)]


def test_a_finished_load_is_not_done_again(spark, stored):
    before = files(stored, JUNE)
    assert not refresh_months(spark, lines(spark, JUNE, 9.0), stored, "1", BILL)
    assert costs(spark, stored)[-1] == (JUNE, 3.0) and files(stored, JUNE) == before


def test_broken_off_while_staging(spark, stored, monkeypatch):
    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(refresh, "_controls", fail)
        with pytest.raises(OSError):
            refresh_months(spark, lines(spark, JUNE, 4.0), stored, "2", BILL)
    assert costs(spark, stored)[-1] == (JUNE, 3.0) and finish_loads(spark, stored, BILL) == []
    assert refresh_months(spark, lines(spark, JUNE, 4.0), stored, "2", BILL)
    assert costs(spark, stored)[-1] == (JUNE, 4.0)


def test_broken_off_while_publishing(spark, stored):
    stage_load(spark, lines(spark, JUNE, 4.0, 5.0), stored, "2", BILL)
    # The stored month is gone and the new one is not there yet.
    shutil.rmtree(f"{stored}/BILLING_PERIOD={JUNE}")
    assert costs(spark, stored) == [(MAY, 1.0), (MAY, 2.0)]
    assert finish_loads(spark, stored, BILL) == ["2"]
    assert costs(spark, stored)[2:] == [(JUNE, 4.0), (JUNE, 5.0)]
    assert finish_loads(spark, stored, BILL) == []


def test_an_older_load_never_replaces_a_newer_one(spark, stored):
    stage_load(spark, lines(spark, JUNE, 4.0), stored, "2", BILL)
    assert refresh_months(spark, lines(spark, JUNE, 6.0), stored, "3", BILL)
    assert costs(spark, stored)[-1] == (JUNE, 6.0)
    assert not refresh_months(spark, lines(spark, JUNE, 4.0), stored, "2", BILL)
    assert costs(spark, stored)[-1] == (JUNE, 6.0)


def test_what_is_stored_must_be_what_was_staged(spark, stored, monkeypatch):
    stage_load(spark, lines(spark, JUNE, 4.0, 5.0), stored, "2", BILL)
    write = refresh._write_months
    with monkeypatch.context() as broken:
        broken.setattr(refresh, "_write_months", lambda rows, path, dynamic: write(rows.limit(1), path, dynamic))
        with pytest.raises(RuntimeError, match="not whole"):
            publish_load(spark, stored, "2", BILL)
    assert finish_loads(spark, stored, BILL) == ["2"]
    assert costs(spark, stored)[2:] == [(JUNE, 4.0), (JUNE, 5.0)]


def test_odd_deliveries(spark, stored):
    for month in (None, "2026-13", "June"):
        with pytest.raises(ValueError, match="billing month"):
            refresh_months(spark, lines(spark, month, 1.0), stored, "bad", BILL)
    with pytest.raises(ValueError, match="load id"):
        refresh_months(spark, lines(spark, JUNE, 1.0), stored, "../x", BILL)
    with pytest.raises(ValueError, match="not staged"):
        publish_load(spark, stored, "never", BILL)
    assert refresh_months(spark, lines(spark, JUNE).limit(0), stored, "none", BILL)
    # Other types and missing columns are brought to the declared schema.
    drifted = spark.createDataFrame([(JUNE, "7.5")], "billing_period string, line_item_unblended_cost string")
    assert refresh_months(spark, drifted, stored, "drifted", BILL)
    assert costs(spark, stored)[2:] == [(JUNE, 7.5)]


def test_a_load_shuffles_once_and_only_what_was_delivered(spark, tmp_path, monkeypatch):
    written = []
    write = DataFrameWriter.parquet

    def noted(writer, path, *args, **options):
        plan = writer._df._jdf.queryExecution().optimizedPlan().toString()
        written.append((path, plan, spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")))
        return write(writer, path, *args, **options)

    drop = ["reservation_effective_cost", "line_item_usage_start_date", "tags"]
    some = ({"period": month, "cost": cost} for month, cost in ((MAY, 1.0), (MAY, 2.0), (JUNE, 3.0)))
    delivered = bill(spark, *some).drop(*drop)
    path = str(tmp_path / "bill")
    with monkeypatch.context() as watched:
        watched.setattr(DataFrameWriter, "parquet", noted)
        assert refresh_months(spark, delivered, path, "1", BILL)
    # The staging folder is written again, empty, when the load is finished.
    plans = {name: (plan, files) for name, plan, files in reversed(written)}
    staging, files = plans[f"{path}/_staging/load=1"]
    published, files_published = plans[path]
    assert "RebalancePartitions" in staging and "RebalancePartitions" not in published
    shuffled = staging[staging.index("RebalancePartitions") :].splitlines()[1]
    assert "resource_id" in shuffled and not any(f" {name}#" in shuffled for name in drop)
    # Lines are not sorted to be written, and the session is as it was.
    assert files == files_published == str(refresh.OPEN_MONTHS)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    stored = read_bill(spark, path, BILL)
    assert costs(spark, path) == [(MAY, 1.0), (MAY, 2.0), (JUNE, 3.0)]
    assert all(stored.where(f"{name} IS NOT NULL").isEmpty() for name in drop)


def test_more_months_than_files_open_and_a_session_that_says_how_many(spark, tmp_path, monkeypatch, conf):
    monkeypatch.setattr(refresh, "OPEN_MONTHS", 2)
    months = [f"20{year}-{month:02}" for year in (24, 25) for month in range(1, 13)]
    delivered = bill(spark, *({"period": month, "cost": float(n)} for n in range(3) for month in months))
    expected = sorted((month, float(n)) for n in range(3) for month in months)
    assert refresh_months(spark, delivered.coalesce(1), str(tmp_path / "sorted"), "1", BILL)
    assert costs(spark, str(tmp_path / "sorted")) == expected
    conf("spark.sql.maxConcurrentOutputFileWriters", "5")
    assert refresh_months(spark, delivered, str(tmp_path / "asked"), "1", BILL)
    assert costs(spark, str(tmp_path / "asked")) == expected
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "5"
