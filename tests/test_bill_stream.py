"""Streams of deliveries against the bill read at once."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators.cost_report import cost_report
from tallyloom.streaming.bill_stream import add_up, bill_stream, left_out, report_so_far, settled_days

SCHEMA = (
    "identity_line_item_id string, line_item_usage_start_date timestamp, "
    "line_item_product_code string, line_item_unblended_cost double"
)
START = dt.datetime(2026, 6, 1)


def by_service(_):
    return {"service": F.col("line_item_product_code")}


def line(number, hours, service="a", cost=1.5):
    return (None if number is None else f"id{number}", START + dt.timedelta(hours=hours), service, cost)


class Drops:
    def __init__(self, spark, folder):
        self.spark, self.files, self.totals = spark, f"{folder}/files", f"{folder}/totals"
        self.schema = spark.createDataFrame([], SCHEMA).schema

    def drop(self, rows, files=1):
        self.spark.createDataFrame(rows, SCHEMA).repartition(files).write.mode("append").parquet(self.files)

    def stream(self, **options):
        return bill_stream(self.spark, self.files, self.schema, **options)

    def run(self, dims=by_service, **options):
        add_up(self.stream(**options), dims, self.totals)

    def report(self):
        found = report_so_far(self.spark, self.totals, T.StructType([T.StructField("service", T.StringType())]))
        return {row.service: (row.cost_usd, row.lines) for row in found.collect()}

    def left_out(self):
        row = left_out(self.spark.read.parquet(self.files), self.totals).first()
        return row.lines, float(row.cost)


@pytest.fixture
def drops(spark, tmp_path):
    return Drops(spark, tmp_path)


def test_late_and_repeated_lines_count_once(drops):
    draw = random.Random(1)
    lines = [line(n, draw.randint(0, 24 * 30), draw.choice("abc"), draw.randint(-900, 900) / 7) for n in range(300)]
    ordered = sorted(lines, key=lambda row: row[1])
    drops.drop(ordered[:100], 3)
    drops.run(files_per_batch=1)
    drops.drop(ordered[60:200] + ordered[60:90])
    drops.run()
    drops.drop(draw.sample(lines, 300), 2)
    drops.run(files_per_batch=1)
    drops.run()  # nothing new
    batch = drops.spark.createDataFrame(lines, SCHEMA)
    wanted = cost_report(batch, by_service(batch)).collect()
    found = drops.report()
    assert {row.service: row.cost_usd for row in wanted} == {service: cost for service, (cost, _) in found.items()}
    assert sum(count for _, count in found.values()) == 300
    assert drops.left_out() == (0, 0.0)


def test_a_batch_that_failed_counts_once(drops):
    drops.drop([line(1, 0), line(2, 1, "b")])
    failing = []

    def dims(frame):
        failing.append(1)
        raise OSError("lost")

    with pytest.raises(Exception, match="lost"):
        drops.run(dims)
    assert failing and drops.report() == {}
    drops.run()
    assert drops.report() == {"a": (1.5, 1), "b": (1.5, 1)}


def test_lines_without_id_and_lines_too_late(drops):
    drops.drop([line(1, 24 * 90), line(None, 24 * 90), line(None, 24 * 90)])
    drops.run()
    drops.drop([line(2, 0, cost=7.0), line(3, 24 * 40), line(1, 24 * 90)])
    drops.run()
    # 90 days less 62 is day 28: the line of day 0 is too late, that of day 40 is not.
    assert drops.report() == {"a": (6.0, 4)}
    assert drops.left_out() == (1, 7.0)


def test_no_files_no_rows(drops):
    drops.drop([])
    drops.run()
    assert drops.report() == {} and drops.left_out() == (0, 0.0)


def test_settled_days(drops):
    drops.drop([line(1, 5), line(2, 6, "b"), line(2, 6, "b"), line(3, 30)])
    path = drops.totals + "-days"
    settled_days(drops.stream(), path, delay="2 days")
    days = lambda: sorted(
        (str(r.usage_date), r.line_item_product_code, float(r.cost), r.lines)
        for r in drops.spark.read.parquet(f"{path}/days").collect()
    )
    drops.drop([line(4, 7), line(5, 24 * 3 + 1)])
    settled_days(drops.stream(), path, delay="2 days")
    assert days() == [("2026-06-01", "a", 3.0, 2), ("2026-06-01", "b", 1.5, 1)]
    drops.drop([line(6, 24 * 9)])
    settled_days(drops.stream(), path, delay="2 days")
    assert days()[2:] == [("2026-06-02", "a", 1.5, 1), ("2026-06-04", "a", 1.5, 1)]
