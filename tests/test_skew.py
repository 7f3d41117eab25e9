"""One order with a third of all lines: the joins split it between tasks."""

import pytest
from pyspark.sql import functions as F

from bills import rows
from conftest import SF_DIR
from tallyloom.checks.order_bill import order_bill
from tallyloom.plans import reports


@pytest.fixture(scope="module")
def skewed_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skewed"))
    for name in ("orders", "part", "supplier", "nation"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").write.parquet(
            f"{folder}/{name}.parquet"
        )
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    hot = F.when(F.col("l_partkey") % 3 == 0, F.lit(1)).otherwise(F.col("l_orderkey"))
    lines.withColumn("l_orderkey", hot.cast("long")).repartition(12).write.parquet(
        f"{folder}/lineitem.parquet"
    )
    return folder


def test_hot_order_is_split_between_tasks(spark, conf, skewed_dir):
    bill = order_bill(
        spark,
        skewed_dir,
        ("line_item_resource_id", "line_item_iam_principal", "line_item_unblended_cost"),
    )
    wanted = rows(reports.principal_cost_any_resource(bill))
    for key, value in {
        "autoBroadcastJoinThreshold": "-1",
        "adaptive.autoBroadcastJoinThreshold": "-1",
        "files.maxPartitionBytes": "20000",
        "shuffle.partitions": "8",
        "adaptive.advisoryPartitionSizeInBytes": "8KB",
        "adaptive.coalescePartitions.parallelismFirst": "false",
        "adaptive.skewJoin.skewedPartitionThresholdInBytes": "8KB",
        "adaptive.skewJoin.skewedPartitionFactor": "2",
    }.items():
        conf(f"spark.sql.{key}", value)
    report = reports.principal_cost_any_resource(bill)
    assert rows(report) == wanted
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin(skew=true)" in plan
