"""Deliveries of bill lines as a stream of files.

Files of new lines are dropped into a folder. Some lines come late, some come twice.
Each line is taken once, by its id: the ids of the last ``delay`` are the state of
the stream, and the watermark, which follows the latest usage seen, clears it. What
is taken is summed exactly, batch by batch, so the report over all batches is that of
the whole bill, whenever and however often a line came.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyloom.functions.amounts import Measure, cost, lines
from tallyloom.operators.cost_report import by_cost, grouped_totals, shown
from tallyloom.sources.bill_schema import BILL_SCHEMA
from tallyloom.sources.shared import parquet_or_none

LINE_ID = "identity_line_item_id"
USAGE_START = "line_item_usage_start_date"
#: A month, and as much again for what is delivered after its end.
DELAY = "62 days"
_KEY = "line_key"


def _totals() -> dict[str, Measure]:
    return {"cost_usd": cost(), "lines": lines()}


def bill_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType = BILL_SCHEMA,
    files_per_batch: int | None = None,
) -> DataFrame:
    """New files of a folder as a stream of lines, oldest file first.

    Files may lie in directories by month, as ``read_bill`` reads them, or in the
    folder itself.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _as_instants(stream: DataFrame) -> DataFrame:
    """The time of usage as an instant, which a watermark needs; without zone it is UTC."""
    if stream.schema[USAGE_START].dataType != T.TimestampNTZType():
        return stream
    since = f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', {USAGE_START})"
    return stream.withColumn(USAGE_START, F.expr(f"timestamp_micros({since})"))


def distinct_lines(stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """Each line once, by its id; the first to come counts.

    A line whose usage is more than ``delay`` before the latest usage of earlier
    batches is too late: whether it came before can't be told any more, so it is
    left out. ``left_out`` tells which those were; the next refresh of their month
    brings them in. Lines without an id can't be told apart: all of them are taken.
    Ids are spread evenly, so no resource or account is one task.
    """
    timed = _as_instants(stream).withColumn(_KEY, _line_key()).withWatermark(USAGE_START, delay)
    return timed.dropDuplicatesWithinWatermark([_KEY]).drop(_KEY)


def _line_key() -> Column:
    return F.coalesce(F.col(LINE_ID), F.concat(F.lit("no id "), F.uuid()))


def _dims(names: Sequence[str]) -> dict[str, Column]:
    return {name: F.col(name) for name in names}


def add_up(
    stream: DataFrame, dims: Callable[[DataFrame], dict[str, Column]], path: str, delay: str = DELAY
) -> StreamingQuery:
    """Sums the distinct lines of every file that is there, then stops.

    ``dims`` gives the dimensions of a frame of lines. Each batch writes the exact
    totals of its lines to a folder of its own under ``path``, and writes the same
    again if it is repeated after a failure. Progress and state are kept under
    ``path`` too: the next call goes on with files that came since.
    """
    folder = path.rstrip("/")

    def write(batch: DataFrame, number: int) -> None:
        totals = grouped_totals(batch, dims(batch), _totals())
        totals.write.mode("overwrite").parquet(f"{folder}/totals/batch={number}")

    query = (
        distinct_lines(stream, delay)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/_progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def report_so_far(spark: SparkSession, path: str, dims: T.StructType, sort: bool = True) -> DataFrame:
    """The report over all batches of ``add_up``: dimensions, ``cost_usd``, ``lines``.

    ``dims`` are the fields of the dimensions. Without any batch it has no rows.
    """
    names = [field.name for field in dims]
    totals = T.StructType(
        [*dims, T.StructField("cost_usd", T.DecimalType(38, 12)), T.StructField("lines", T.LongType())]
    )
    parts = parquet_or_none(spark, f"{path.rstrip('/')}/totals", totals)
    if parts is None:
        parts = spark.createDataFrame([], totals)
    sums = {name: Measure(F.sum(name), measure.shown) for name, measure in _totals().items()}
    report = shown(grouped_totals(parts, _dims(names), sums), sums)
    return report.orderBy(*by_cost(names)) if sort else report


def settled_days(
    stream: DataFrame, path: str, by: Sequence[str] = ("line_item_product_code",), delay: str = DELAY
) -> StreamingQuery:
    """Totals of days that no line can change any more, appended to ``path``.

    A day is settled once the watermark has passed its end: it is written then, and
    once. Columns: ``usage_date`` (UTC), those of ``by``, ``cost`` (exact), ``lines``.
    """
    folder = path.rstrip("/")
    day = F.window(USAGE_START, "1 day")
    totals = (
        distinct_lines(stream, delay)
        .groupBy(day.alias("day"), *by)
        .agg(*(measure.total.alias(name) for name, measure in _totals().items()))
        .select(
            F.date_from_unix_date((F.unix_seconds("day.start") / 86_400).cast("int")).alias("usage_date"),
            *by,
            F.col("cost_usd").alias("cost"),
            "lines",
        )
    )
    query = (
        totals.writeStream.outputMode("append")
        .option("checkpointLocation", f"{folder}/_progress")
        .option("path", f"{folder}/days")
        .format("parquet")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def left_out(files: DataFrame, path: str) -> DataFrame:
    """Lines and exact cost that are in the files but in no batch of ``add_up``: one row.

    ``files`` is the folder of deliveries read as a table. Zero in both columns
    means that no line was too late, so the report so far is that of the bill.
    """
    spark = files.sparkSession
    schema = f"cost_usd {T.DecimalType(38, 12).simpleString()}, lines long"
    taken = parquet_or_none(spark, f"{path.rstrip('/')}/totals", schema)
    if taken is None:
        taken = spark.createDataFrame([], schema)
    # Copies of a line agree, so any of them will do; each is reduced where it is read.
    once = files.groupBy(_line_key()).agg(F.first("line_item_unblended_cost").alias("line_item_unblended_cost"))
    whole = grouped_totals(once, {}, _totals()).select("cost_usd", "lines")
    part = taken.agg((-F.sum("cost_usd")).alias("cost_usd"), (-F.sum("lines")).alias("lines"))
    both = whole.unionAll(part.select(F.col("cost_usd").cast("decimal(38,12)"), "lines"))
    return both.agg(
        F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"),
        F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("decimal(38,12)").alias("cost"),
    )
