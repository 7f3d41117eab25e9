"""Times the reports and prints one line of JSON.

``value`` is the total time of all reports over the whole bill made of the order
tables; those that write files first (loads, streams, sketches) run once and are not in
it. Keys with ``table:`` are reports over the same lines stored as a bill
table (declared schema, one directory per month), which is how a bill is kept in
practice. Keys with ``month:`` are reports over one stored month of as many lines as
the published one (``$BENCH_MONTH_LINES``, 1,142,147): order lines, repeated with
shifted keys. Writing the tables is not timed.

Each query is built, planned and run to the end, its rows discarded. Of whole-bill
and table queries the best of ``$BENCH_RUNS`` (2) runs counts; of month queries,
after one run to warm up, the median of ``$BENCH_MONTH_RUNS`` (5). Tables are
written to ``$BENCH_STORE``, a folder that all executors see, or to a temporary
one on a single machine.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from collections.abc import Callable
from functools import partial, reduce
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.checks.order_bill import order_bill
from tallyloom.checks.registry import MONTH, REPORTS, all_queries
from tallyloom.checks.stored_bill import STORED_QUERIES
from tallyloom.plans import rank, reconcile, reports
from tallyloom.sources.bill import read_bill
from tallyloom.sources.bill_schema import PARTITION_COLUMN
from tallyloom.sources.conform import conform

PUBLISHED_LINES = 1_142_147
TABLE_REPORTS = (
    "cost_by_resource",
    "cost_by_service",
    "cost_by_tag_principal",
    "tag_total",
    "panorama",
    "reconcile",
)
MONTH_REPORTS = {
    "top_resources": partial(rank.top_resources, n=20),
    "panorama": reports.panorama,
    "reconcile": reconcile.reconcile,
    "tag_total": reports.tag_total,
}


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def times_of(build: Callable[[], DataFrame], runs: int) -> list[float]:
    found = []
    for _ in range(runs):
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        found.append(time.perf_counter() - start)
    return found


def seconds(build: Callable[[], DataFrame], runs: int) -> float:
    return round(min(times_of(build, runs)), 3)


def store_bill(spark: SparkSession, sf_dir: str, path: str, cpus: int) -> DataFrame:
    lines = conform(order_bill(spark, sf_dir)).repartition(cpus, PARTITION_COLUMN)
    lines.write.partitionBy(PARTITION_COLUMN).parquet(path)
    return read_bill(spark, path)


def store_month(
    spark: SparkSession, sf_dir: str, path: str, cpus: int, wanted: int
) -> DataFrame:
    """One month of about ``wanted`` lines; copies have resource ids of their own."""
    lines = conform(order_bill(spark, sf_dir)).withColumn(PARTITION_COLUMN, F.lit(MONTH))
    have = lines.count()
    resource = F.col("line_item_resource_id")
    parts = []
    for copy in range(-(-wanted // have)):
        share = min(1.0, wanted / have - copy)
        own = F.when(resource != "", F.concat(resource, F.lit(f"-{copy}"))).otherwise(resource)
        shifted = lines if copy == 0 else lines.withColumn("line_item_resource_id", own)
        parts.append(shifted if share == 1.0 else shifted.where(F.rand(copy) < share))
    whole = reduce(DataFrame.unionByName, parts).repartition(cpus)
    whole.write.partitionBy(PARTITION_COLUMN).parquet(path)
    return read_bill(spark, path, period=MONTH)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    month_runs = int(os.environ.get("BENCH_MONTH_RUNS", "5"))
    month_lines = int(os.environ.get("BENCH_MONTH_LINES", str(PUBLISHED_LINES)))
    spark = session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    times: dict[str, float] = {}

    queries["panorama"](spark, sf_dir).count()  # start the JVM's compilers
    whole_bill = [
        name
        for name in queries
        if not name.endswith(("_month", "_year")) and name not in STORED_QUERIES
    ]
    for name in whole_bill:
        times[name] = seconds(lambda: queries[name](spark, sf_dir), runs)
    total = round(sum(times.values()), 3)
    times["cost_by_resource_month"] = seconds(
        lambda: queries["cost_by_resource_month"](spark, sf_dir), runs
    )

    for name in STORED_QUERIES:  # these write files first
        times[name] = seconds(lambda: queries[name](spark, sf_dir), 1)

    store = os.environ.get("BENCH_STORE")
    with tempfile.TemporaryDirectory(prefix="bench-", dir=store) as folder:
        bill = store_bill(spark, sf_dir, f"{folder}/bill", int(cpus))
        for name in TABLE_REPORTS:
            report, _ = REPORTS[name]
            times[f"table:{name}"] = seconds(lambda: report(bill, None), runs)
            times[f"table:{name}_month"] = seconds(lambda: report(bill, MONTH), runs)
        month = store_month(spark, sf_dir, f"{folder}/month", int(cpus), month_lines)
        for name, report in MONTH_REPORTS.items():
            warm = times_of(lambda: report(month, period=MONTH), month_runs + 1)[1:]
            times[f"month:{name}"] = round(median(warm), 3)

    print(
        json.dumps(
            {
                "metric": "all reports over the whole bill",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
