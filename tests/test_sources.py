"""Schema, reading, conforming and writing."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bills import BILL, bill, rows
from conftest import SF_DIR
from tallyloom.checks.order_bill import order_bill
from tallyloom.operators.periods import missing_periods, partition_values
from tallyloom.operators.profile import column_profile, preview, row_order
from tallyloom.plans import reconcile, reports
from tallyloom.sources.bill import for_period, read_bill
from tallyloom.sources.bill_schema import BILL_DATA_SCHEMA, BILL_SCHEMA
from tallyloom.sources.conform import conform, schema_drift
from tallyloom.sources.report_files import read_report, write_report


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The order bill as a bill table: upper-case directories, one per month."""
    path = str(tmp_path_factory.mktemp("bill"))
    lines = conform(order_bill(spark, SF_DIR, period=("1997-05", "1997-07")))
    lines.withColumnRenamed("billing_period", "BILLING_PERIOD").write.mode(
        "append"
    ).partitionBy("BILLING_PERIOD").parquet(path)
    return path


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_declared_schema():
    kinds = Counter(field.dataType.simpleString() for field in BILL_DATA_SCHEMA)
    assert kinds == {
        "string": 78, "double": 44, "timestamp": 4, "map<string,string>": 5,
    }
    prefixes = Counter(name.split("_")[0] for name in BILL_DATA_SCHEMA.names)
    assert prefixes == {
        "bill": 8, "capacity": 3, "cost": 1, "discount": 3, "identity": 2, "line": 25,
        "pricing": 10, "product": 22, "reservation": 27, "resource": 1, "savings": 17,
        "split": 11, "tags": 1,
    }
    assert BILL_SCHEMA.names == BILL_DATA_SCHEMA.names + ["billing_period"]
    assert BILL_SCHEMA["billing_period"].dataType == T.StringType()


def test_read_bill(spark, stored):
    table = read_bill(spark, stored)
    assert table.schema == BILL_SCHEMA
    made = order_bill(spark, SF_DIR, period=("1997-05", "1997-07"))
    for report in (reports.panorama, reports.tag_total, reports.cost_by_resource_day):
        assert rows(report(table)) == rows(report(made))
    reconcile.assert_reconciled(reconcile.reconcile(table, "1997-06"))


def test_new_month_is_seen_without_repair(spark, tmp_path):
    path = str(tmp_path / "bill")
    june = conform(bill(spark, {"resource": "r"}))
    june.write.partitionBy("billing_period").parquet(path)
    assert reports.grand_total(read_bill(spark, path)).first().raw_line_items == 1
    july = conform(bill(spark, {"resource": "r", "period": "2026-07"}))
    july.write.mode("append").partitionBy("billing_period").parquet(path)
    table = read_bill(spark, path)
    assert reports.grand_total(table).first().raw_line_items == 2
    assert rows(partition_values(table)) == [("2026-06",), ("2026-07",)]
    assert rows(partition_values(table, limit=1)) == [("2026-06",)]


def test_partition_values_are_whole_unless_limited(spark):
    pairs = spark.range(900).selectExpr("id % 30 AS a", "id div 30 AS b")
    found = rows(partition_values(pairs, ("a", "b")))
    assert found == [(a, b) for a in range(30) for b in range(30)]
    assert rows(partition_values(pairs, ("a", "b"), limit=7)) == found[:7]


@pytest.mark.parametrize("name", ["BILLING_PERIOD", "billing_period"])
def test_read_lists_only_the_months_of_the_period(spark, tmp_path, name):
    path = str(tmp_path / "bill")
    for month in ("2026-04", "2026-05", "2026-07"):
        lines = conform(bill(spark, {"resource": month, "period": month})).drop("billing_period")
        lines.write.parquet(f"{path}/{name}={month}")
    whole = read_bill(spark, path)
    for period in ("2026-05", ("2026-05", "2026-08")):
        part = read_bill(spark, path, period=period)
        assert part.schema == whole.schema
        months = {"2026-05"} if isinstance(period, str) else {"2026-05", "2026-07"}
        assert {file.split("=")[1][:7] for file in part.inputFiles()} == months
        assert sorted(rows(reports.cost_by_resource(part))) == sorted(
            rows(reports.cost_by_resource(whole, period))
        )
    none = read_bill(spark, path, period="2026-06")
    assert none.schema == whole.schema and none.isEmpty()


def test_reversed_ranges_raise(spark, stored):
    for wrong in (
        lambda: for_period(read_bill(spark, stored), ("1997-07", "1997-05")),
        lambda: read_bill(spark, stored, period=("1997-07", "1997-05")),
        lambda: missing_periods(read_bill(spark, stored), "1997-07", "1997-05"),
    ):
        with pytest.raises(ValueError, match="reversed"):
            wrong()


def test_missing_periods_scans_its_range_only(spark, stored, conf):
    conf("spark.sql.maxMetadataStringLength", "1000")
    text = plan(missing_periods(read_bill(spark, stored), "1997-06", "1997-09"))
    assert ">= 1997-06" in text and "<= 1997-09" in text


def test_month_prunes_directories_and_columns(spark, stored, conf):
    conf("spark.sql.maxMetadataStringLength", "1000")
    text = plan(reports.cost_by_resource(read_bill(spark, stored), "1997-06"))
    assert "PartitionFilters: [isnotnull(billing_period#" in text
    assert "Not(EqualTo(line_item_resource_id,))" in text
    read = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert {column.split(":")[0] for column in read.split(",")} == {
        "line_item_resource_id", "line_item_product_code", "product_region_code",
        "line_item_unblended_cost",
    }
    assert "Batched: true" in text


def test_partition_values_read_no_columns(spark, stored):
    assert "ReadSchema: struct<>" in plan(partition_values(read_bill(spark, stored)))


def test_period_range(spark, stored):
    table = read_bill(spark, stored)
    found = for_period(table, ("1997-06", "1997-07")).select("billing_period").distinct()
    assert sorted(rows(found)) == [("1997-06",), ("1997-07",)]


def test_missing_periods(spark, stored):
    gaps = missing_periods(read_bill(spark, stored), "1997-03", "1997-09")
    assert rows(gaps) == [("1997-03",), ("1997-04",), ("1997-08",), ("1997-09",)]


def test_column_missing_in_older_files_is_null(spark, tmp_path):
    path = str(tmp_path / "bill")
    conform(bill(spark, {"principal": "p"})).drop("line_item_iam_principal").write.parquet(
        f"{path}/BILLING_PERIOD=2026-05"
    )
    conform(bill(spark, {"principal": "p"})).write.parquet(f"{path}/BILLING_PERIOD=2026-06")
    found = read_bill(spark, path).select("billing_period", "line_item_iam_principal")
    assert sorted(rows(found.where("billing_period = '2026-05'"))) == [("2026-05", None)]
    assert reports.cost_by_principal(read_bill(spark, path)).first().cost_usd == 1.0


def test_conform_casts_orders_and_fills(spark):
    drifted = spark.createDataFrame(
        [("3.5", "r", 7, dt.date(2026, 6, 1))],
        "LINE_ITEM_UNBLENDED_COST string, line_item_resource_id string, extra int, "
        "line_item_usage_start_date date",
    ).withColumn("billing_period", F.lit("2026-06"))
    good = conform(drifted)
    assert good.schema.simpleString() == BILL_SCHEMA.simpleString()
    row = good.first()
    assert row.line_item_unblended_cost == 3.5 and row.line_item_resource_id == "r"
    assert row.resource_tags is None and row.line_item_usage_start_date is not None
    drift = {(r.column_name.lower(), r.drift) for r in schema_drift(drifted).collect()}
    assert ("extra", "undeclared") in drift and ("tags", "missing") in drift
    assert ("line_item_unblended_cost", "type") in drift
    assert "line_item_resource_id" not in {name for name, _ in drift}
    assert schema_drift(good).isEmpty()


@pytest.mark.parametrize("zone", ["UTC", "Asia/Shanghai", "America/New_York"])
def test_conform_keeps_utc_days(spark, conf, zone):
    conf("spark.sql.session.timeZone", zone)
    day = {
        "TIMESTAMP_NTZ'2026-06-01 01:00:00'": "2026-06-01",
        "TIMESTAMP_NTZ'2026-06-01 23:30:00.5'": "2026-06-01",
        "DATE'2026-06-01'": "2026-06-01",
        "TIMESTAMP'2026-06-01 01:00:00+03:00'": "2026-05-31",
        "'2026-06-01 01:00:00'": "2026-06-01",
        "'2026-06-01T23:59:59.25'": "2026-06-01",
        "' 2026-06-01 '": "2026-06-01",
        "'2026-06-01T01:00:00Z'": "2026-06-01",
        "'2026-06-01 01:00:00 UTC'": "2026-06-01",
        "'2026-06-01T01:00:00+03:00'": "2026-05-31",
        "'2026-06-01 22:00:00-05:00'": "2026-06-02",
        "'2026-06-01 01:00:00 Asia/Tokyo'": "2026-05-31",
    }
    for value, wanted in day.items():
        raw = spark.sql(
            f"SELECT 'r' AS line_item_resource_id, 1D AS line_item_unblended_cost, "
            f"{value} AS line_item_usage_start_date, '2026-06' AS billing_period"
        )
        found = reports.cost_by_resource_day(conform(raw)).first()
        assert str(found.usage_date) == wanted, value


def test_columns_twice_but_for_case(spark, conf):
    conf("spark.sql.caseSensitive", "true")
    twice = spark.createDataFrame([(1.0, 2.0, 1, 2)], "tags_x double, Tags_X double, a int, A int")
    conform(twice).collect()  # neither is declared
    both = twice.withColumnsRenamed({"a": "bill_bill_type", "A": "BILL_BILL_TYPE"})
    with pytest.raises(ValueError, match="bill_bill_type"):
        conform(both)
    drift = {(r.column_name, r.drift) for r in schema_drift(both).collect()}
    assert {("bill_bill_type", "duplicate"), ("BILL_BILL_TYPE", "duplicate")} <= drift


def test_conform_does_not_lose_values_silently(spark):
    bad = spark.createDataFrame([("n/a",)], "line_item_unblended_cost string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        conform(bad).collect()


def test_column_profile(spark):
    lines = bill(
        spark,
        {"resource": "", "resource_tags": {}},
        {"resource": None},
        {"resource": "r", "resource_tags": {"a": "b"}},
    )
    for per_pass in (1, 4, 50):
        found = {r.column_name: r for r in column_profile(lines, columns_per_pass=per_pass).collect()}
        assert list(found) == lines.columns or set(found) == set(lines.columns)
        row = found["line_item_resource_id"]
        assert (row.data_type, row.row_count, row.null_count, row.blank_count) == ("string", 3, 1, 1)
        assert (found["resource_tags"].null_count, found["resource_tags"].blank_count) == (1, 0)
        assert [n for n, r in found.items() if r.is_partition] == ["billing_period"]


def test_column_profile_of_odd_names(spark):
    odd = spark.createDataFrame([("", None), (None, 1)], "`it's a.b` string, `c``d` int")
    found = sorted(tuple(row) for row in column_profile(odd).collect())
    assert found == [("c`d", "int", False, 2, 1, 0), ("it's a.b", "string", False, 2, 1, 1)]


def test_preview(spark, stored):
    assert preview(read_bill(spark, stored)).count() == 10
    assert preview(read_bill(spark, stored), 3).count() == 3
    table = read_bill(spark, stored)
    ordered = rows(preview(table, 5, order=row_order(table)))
    assert ordered == rows(preview(table.repartition(7), 5, order=row_order(table)))


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_write_report_round_trip(spark, tmp_path, fmt):
    lines = bill(
        spark,
        {"resource": 'quote " and, comma', "region": "", "cost": 3.0},
        {"resource": "back\\slash", "region": None, "cost": 2.0},
        {"resource": "zażółć", "region": "eu", "cost": -1.5},
    )
    report = reports.cost_by_resource(lines)
    path = str(tmp_path / "report")
    write_report(report, path, fmt)
    reader = spark.read.schema(report.schema)
    back = (
        read_report(spark, path, report.schema)
        if fmt == "csv"
        else reader.parquet(path)
    )
    assert sorted(rows(back), key=repr) == sorted(rows(report), key=repr)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_report(report, path, fmt)
    write_report(report, path, fmt, mode="overwrite")
    with pytest.raises(ValueError):
        write_report(report, path, "xls")


@pytest.mark.parametrize("mark", [None, "NULL"])
def test_null_and_blank_stay_apart_in_csv(spark, tmp_path, mark):
    lines = bill(
        spark,
        {"resource_tags": {"k": ""}, "cost": 3.0},
        {"resource_tags": None, "cost": 2.0},
        {"resource_tags": {"k": "v"}},
    )
    report = reports.cost_by_tag(lines, "k")
    path = str(tmp_path / "report")
    options = {} if mark is None else {"null_value": mark}
    write_report(report, path, **options)
    back = read_report(spark, path, report.schema, **options)
    assert sorted(rows(back), key=repr) == [("", 3.0), ("v", 1.0), (None, 2.0)]


def test_written_report_is_in_order(spark, tmp_path):
    lines = bill(spark, *({"resource": f"r{n}", "cost": float(n)} for n in range(300)))
    path = str(tmp_path / "report")
    write_report(reports.cost_by_resource(lines), path)
    costs = [
        float(line.split(",")[-1])
        for part in sorted((tmp_path / "report").glob("part-*.csv"))
        for line in part.read_text().splitlines()[1:]
    ]
    assert costs == sorted(costs, reverse=True) and len(costs) == 300


def test_a_bill_known_by_name(spark, tmp_path):
    from tallyloom.sources.bill import read_bill_table

    lines = bill(spark, {"period": "2026-05", "cost": 1.0}, {"period": "2026-06", "cost": 2.0}, {"period": "2026-06", "cost": 3.0})
    slim = lines.select("line_item_unblended_cost", "billing_period").withColumn("else", F.lit(1))
    spark.sql("DROP TABLE IF EXISTS named_bill")
    try:
        slim.write.option("path", str(tmp_path / "named")).partitionBy("billing_period").saveAsTable("named_bill")
        found = read_bill_table(spark, "named_bill", BILL, period="2026-06")
        assert found.columns == BILL.names
        assert sorted(row.line_item_unblended_cost for row in found.collect()) == [2.0, 3.0]
        assert found.where("line_item_resource_id IS NOT NULL").isEmpty()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(billing_period" in plan
    finally:
        spark.sql("DROP TABLE IF EXISTS named_bill")
