"""A bill made of order tables, to run the reports on known data.

Every order line becomes one charge line. Resource, principal, region and tags
are NULL, blank, absent or coarse by rule, so that all cases a real bill has
occur and groups merge many lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.bill import Period, check_month

# The columns of the order tables which the bill is made of. Declared, so that
# reading a table does not start a job to find its schema.
_TABLES = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, "
    "l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_returnflag string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string",
    "part": "p_partkey bigint, p_brand string, p_type string",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "nation": "n_nationkey int, n_regionkey int",
}


_DISCOUNT = "CAST(l_discount AS DECIMAL(15,2))"


def _part_of_price(line: int, part: str = f"(CAST(1 AS DECIMAL(15,2)) - {_DISCOUNT})") -> str:
    return f"""CASE WHEN l_linenumber = {line}
        THEN CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * {part} AS DOUBLE)
        ELSE 0D END"""


def _tag(key: str, present: str, value: str) -> str:
    """One-entry array, or an empty one: only so far as the tag is present."""
    entry = f"array(named_struct('key', '{key}', 'value', {value}))"
    return f"IF({present}, {entry}, CAST(array() AS ARRAY<STRUCT<key STRING, value STRING>>))"


_PLAIN_TAGS = ", ".join(
    [
        _tag("env", "l_suppkey % 4 <> 1", "IF(l_suppkey % 4 = 2, '', 'env/' || (l_partkey % 3))"),
        _tag("team", "l_suppkey % 5 = 0", "'team/' || (l_partkey % 2)"),
    ]
)
_TAGS = ", ".join(
    [
        _tag(
            "user_project",
            "l_suppkey % 4 <> 0",
            "IF(l_suppkey % 4 = 1, '', 'project/' || (l_partkey % 3))",
        ),
        _tag("user_owner", "l_suppkey % 3 <> 0", "'owner/' || (l_partkey % 4)"),
        _tag("user_name", "l_suppkey % 5 <> 1 AND p_type IS NOT NULL", "p_type"),
        _tag(
            "user_parallelcluster_cluster_name",
            "l_suppkey % 7 = 1",
            "'cluster/' || (l_partkey % 2)",
        ),
    ]
)

_EXPRESSIONS = {
    "billing_period": "date_format(l_shipdate, 'yyyy-MM')",
    "line_item_usage_start_date": "l_shipdate"
    " + make_dt_interval(0, CAST(l_orderkey % 24 AS INT), 0, 0)",
    "line_item_resource_id": "CASE WHEN l_partkey % 10 <= 2 THEN ''"
    " WHEN l_partkey % 10 > 3 THEN 'res/' || (l_partkey % 40) END",
    "line_item_line_item_type": "CASE l_linenumber WHEN 1 THEN 'Usage'"
    " WHEN 2 THEN 'DiscountedUsage' WHEN 3 THEN 'SavingsPlanCoveredUsage'"
    " WHEN 4 THEN 'SavingsPlanRecurringFee' WHEN 5 THEN 'SavingsPlanNegation'"
    " WHEN 6 THEN 'Tax' ELSE 'Credit' END",
    "line_item_product_code": "p_type",
    "line_item_usage_type": "p_brand",
    "line_item_operation": "l_returnflag",
    "product_region_code": "CASE WHEN n_regionkey = 0 THEN ''"
    " WHEN n_regionkey <> 1 THEN 'region-' || n_regionkey END",
    "line_item_iam_principal": "o_principal",
    "line_item_usage_amount": "l_quantity",
    "line_item_unblended_cost": "IF(l_linenumber IN (5, 7), -l_extendedprice,"
    " l_extendedprice)",
    "savings_plan_savings_plan_effective_cost": _part_of_price(3),
    "reservation_effective_cost": _part_of_price(2),
    "savings_plan_total_commitment_to_date": "IF(l_linenumber = 4, l_extendedprice, NULL)",
    "savings_plan_used_commitment": _part_of_price(4),
    "reservation_unused_recurring_fee": _part_of_price(2, _DISCOUNT),
    "reservation_unused_amortized_upfront_fee_for_billing_period": "IF(l_linenumber = 2"
    " AND l_partkey % 2 = 1, l_quantity, NULL)",
    "resource_tags": f"IF(l_suppkey % 10 <> 0, map_from_entries(concat({_TAGS})), NULL)",
    "tags": f"IF(l_suppkey % 6 <> 0, map_from_entries(concat({_PLAIN_TAGS})), NULL)",
}
BILL_COLUMNS = tuple(_EXPRESSIONS)
#: The principal of an order, made before the join: lines carry no keys for it.
_PRINCIPAL = """CASE WHEN o_orderstatus = 'P' THEN ''
    WHEN o_orderstatus <> 'F' THEN 'user/' || (o_custkey % 5) END AS o_principal"""
# Columns that some reports ask for by name, and the bill has not got otherwise.
_FEE = "l_linenumber = 4"
_MORE = {
    "identity_line_item_id": "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,"
    " CAST(round(100 * l_extendedprice) AS BIGINT), CAST(l_quantity AS BIGINT),"
    " date_format(l_shipdate, 'yyyyMMdd'))",
    "line_item_usage_end_date": "l_shipdate + make_dt_interval(0,"
    " CAST(l_orderkey % 24 + 1 + l_quantity % 8 AS INT), 0, 0)",
    "savings_plan_savings_plan_a_r_n": f"IF({_FEE}, 'plan/' || (l_partkey % 12), NULL)",
    "savings_plan_start_time": f"IF({_FEE}, date_format(l_shipdate, 'yyyy-MM') || '-01T00:00:00Z', NULL)",
    "savings_plan_end_time": f"IF({_FEE}, date_format(add_months(trunc(l_shipdate, 'MM'),"
    " CAST(1 + l_partkey % 3 AS INT)), 'yyyy-MM') || '-01 00:00:00', NULL)",
}
_OF_ORDERS = {"line_item_iam_principal"}
_OF_PART = {"line_item_product_code", "line_item_usage_type", "resource_tags"}
_OF_SUPPLIER = {"product_region_code"}


def _ship_dates(lines: DataFrame, period: Period) -> DataFrame:
    """Bound the ship date, which the Parquet scan can check by row group."""
    if period is None:
        return lines
    first, last = (period, period) if isinstance(period, str) else period
    start = F.lit(check_month(first) + "-01").cast("timestamp_ntz")
    stop = F.lit(check_month(last) + "-01").cast("timestamp_ntz")
    shipped = F.col("l_shipdate")
    return lines.where(
        (shipped >= start) & (shipped < stop + F.expr("INTERVAL 1 MONTH"))
    )


def order_bill(
    spark: SparkSession,
    sf_dir: str,
    columns: Sequence[str] = BILL_COLUMNS,
    period: Period = None,
) -> DataFrame:
    """The bill over the order tables in ``sf_dir``, with the given columns.

    Only the tables these columns come from are joined; ``_MORE`` are columns besides
    ``BILL_COLUMNS``, for those who name them. All joins are left joins
    on unique keys, so each line stays exactly once whichever are done. Sides
    are broadcast only where Spark finds them small enough; supplier and nation
    meet first, so that the lines are joined once for both, and after the larger
    tables: by then their size is known. Texts of the part are not shuffled for the
    orders, which come first.
    """
    wanted = set(columns)

    def table(name: str) -> DataFrame:
        return spark.read.schema(_TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")

    bill = _ship_dates(table("lineitem"), period)
    if wanted & _OF_ORDERS:
        principals = table("orders").selectExpr("o_orderkey", _PRINCIPAL)
        bill = bill.join(
            principals, F.col("l_orderkey") == F.col("o_orderkey"), "left"
        )
    if wanted & _OF_PART:
        bill = bill.join(
            table("part"), F.col("l_partkey") == F.col("p_partkey"), "left"
        )
    if wanted & _OF_SUPPLIER:
        located = table("supplier").join(
            table("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left"
        )
        bill = bill.join(located, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return bill.selectExpr(*(f"{(_EXPRESSIONS | _MORE)[name]} AS {name}" for name in columns))
