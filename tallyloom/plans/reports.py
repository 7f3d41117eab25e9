"""The cost reports.

Each takes the bill and a period: a month ``'2026-06'``, an inclusive range
``('2026-01', '2026-06')``, or ``None`` for the whole bill. Unless a docstring
says otherwise a report has the highest cost first, and its costs add up to the
cost of the lines its filter keeps.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.amounts import cost, distinct_resources, lines, usage_amount
from tallyloom.functions.columns import (
    filled,
    is_blank,
    or_placeholder,
    tag,
    utc_date,
)
from tallyloom.operators.cost_report import Dims, by_cost, cost_report
from tallyloom.sources.bill import Period

# Placeholders, charge types and tag keys of the bill format.
NO_RESOURCE = "(no resource id)"
NO_PRINCIPAL = "(no principal)"
UNTAGGED = "(untagged)"
NOTHING = "-"
USAGE_CHARGES = ("Usage", "DiscountedUsage", "SavingsPlanCoveredUsage")
PANORAMA_TAGS = {
    "tag_project": "user_project",
    "tag_owner": "user_owner",
    "tag_name": "user_name",
    "tag_cluster": "user_parallelcluster_cluster_name",
}


def _resource() -> Column:
    return F.col("line_item_resource_id")


def _principal() -> Column:
    return F.col("line_item_iam_principal")


def _service() -> Column:
    return F.col("line_item_product_code")


def _charge_type() -> Column:
    return F.col("line_item_line_item_type")


def _any_principal() -> Column:
    return or_placeholder(_principal(), NO_PRINCIPAL)


def _tag_dims(tags: Mapping[str, str], tags_column: str) -> Dims:
    tag_map = F.col(tags_column)
    return {name: or_placeholder(tag(tag_map, key), NOTHING) for name, key in tags.items()}


def cost_by_resource(bill: DataFrame, period: Period = None, sort: bool = True) -> DataFrame:
    """Cost of each resource, with its service and region."""
    dims = {
        "resource_id": _resource(),
        "service": _service(),
        "region": F.col("product_region_code"),
    }
    return cost_report(bill, dims, period=period, where=[filled(_resource())], sort=sort)


def resource_detail(
    bill: DataFrame, resource_id: str, period: Period = None, sort: bool = True
) -> DataFrame:
    """What one resource was charged for, and how much of it was used."""
    dims = {
        "resource_id": _resource(),
        "service": _service(),
        "usage_type": F.col("line_item_usage_type"),
        "operation": F.col("line_item_operation"),
        "charge_type": _charge_type(),
    }
    measures = {"usage_amount": usage_amount(), "cost_usd": cost()}
    return cost_report(
        bill, dims, measures, period, where=[_resource() == resource_id], sort=sort
    )


def cost_by_resource_day(
    bill: DataFrame, period: Period = None, sort: bool = True
) -> DataFrame:
    """Cost of each resource on each UTC day, in the order of days."""
    dims = {
        "usage_date": utc_date(bill, "line_item_usage_start_date"),
        "resource_id": _resource(),
    }
    order = [F.asc_nulls_last("usage_date"), *by_cost(dims)]
    return cost_report(
        bill, dims, period=period, where=[filled(_resource())], order=order, sort=sort
    )


def cost_by_service(bill: DataFrame, period: Period = None, sort: bool = True) -> DataFrame:
    """Cost of each service: the totals to check drill-downs against."""
    return cost_report(bill, {"service": _service()}, period=period, sort=sort)


def service_drilldown(
    bill: DataFrame, service: str, period: Period = None, sort: bool = True
) -> DataFrame:
    """Cost and usage within one service, by resource, usage type and operation."""
    dims = {
        "resource_id": _resource(),
        "usage_type": F.col("line_item_usage_type"),
        "operation": F.col("line_item_operation"),
    }
    measures = {"usage_amount": usage_amount(), "cost_usd": cost()}
    return cost_report(
        bill, dims, measures, period, where=[_service() == service], sort=sort
    )


def usage_cost_by_resource(
    bill: DataFrame, period: Period = None, sort: bool = True
) -> DataFrame:
    """Cost of each resource from usage only: no tax, credit, refund or fee."""
    return cost_report(
        bill,
        {"resource_id": _resource(), "service": _service()},
        period=period,
        where=[filled(_resource()), _charge_type().isin(*USAGE_CHARGES)],
        sort=sort,
    )


def cost_by_tag(
    bill: DataFrame,
    key: str,
    period: Period = None,
    tags_column: str = "resource_tags",
    tag_name: str = "tag_value",
    sort: bool = True,
) -> DataFrame:
    """Cost of each value of one tag, raw: no tag and a blank tag stay apart."""
    return cost_report(
        bill, {tag_name: tag(F.col(tags_column), key)}, period=period, sort=sort
    )


def cost_by_resource_principal(
    bill: DataFrame, period: Period = None, sort: bool = True
) -> DataFrame:
    """Who used which resource; lines lacking either are left out."""
    dims = {
        "resource_id": _resource(),
        "iam_principal": _principal(),
        "service": _service(),
    }
    return cost_report(
        bill,
        dims,
        period=period,
        where=[filled(_resource()), filled(_principal())],
        sort=sort,
    )


def cost_by_resource_any_principal(
    bill: DataFrame, period: Period = None, sort: bool = True
) -> DataFrame:
    """Who used which resource; lines without principal get a placeholder."""
    dims = {
        "resource_id": _resource(),
        "iam_principal": _any_principal(),
        "service": _service(),
    }
    return cost_report(bill, dims, period=period, where=[filled(_resource())], sort=sort)


def cost_by_principal(
    bill: DataFrame, period: Period = None, sort: bool = True
) -> DataFrame:
    """Cost of each principal and the number of resource ids it used.

    No filter on resources: a blank id counts as one resource, NULL as none.
    """
    measures = {"cost_usd": cost(), "distinct_resources": distinct_resources()}
    return cost_report(
        bill,
        {"iam_principal": _principal()},
        measures,
        period,
        where=[filled(_principal())],
        sort=sort,
    )


def principal_cost_any_resource(
    bill: DataFrame, period: Period = None, sort: bool = True
) -> DataFrame:
    """Cost by resource and principal, keeping lines whose resource is blank."""
    return cost_report(
        bill,
        {"resource_id": _resource(), "iam_principal": _principal()},
        period=period,
        where=[filled(_principal())],
        sort=sort,
    )


def tag_keys(
    bill: DataFrame,
    period: Period = None,
    tags_column: str = "resource_tags",
    sort: bool = True,
) -> DataFrame:
    """The tag keys in use, with lines and cost.

    A line with several tags counts under each of them and a line without tags
    under none, so the costs do not add up to the bill.
    """
    keyed = bill.withColumn("tag_key", F.explode(F.map_keys(tags_column)))
    measures = {"rows_cnt": lines(), "cost_usd": cost()}
    return cost_report(keyed, {"tag_key": F.col("tag_key")}, measures, period, sort=sort)


def tag_total(
    bill: DataFrame,
    period: Period = None,
    tags_column: str = "resource_tags",
    sort: bool = True,
) -> DataFrame:
    """Cost by resource, principal and every tag it carries, keys not known ahead.

    As with ``tag_keys``, the costs do not add up to the bill.
    """
    tagged = bill.select("*", F.explode(tags_column).alias("tag_key", "tag_value"))
    dims = {
        "resource_id": _resource(),
        "iam_principal": _any_principal(),
        "tag_key": F.col("tag_key"),
        "tag_value": F.col("tag_value"),
    }
    return cost_report(tagged, dims, period=period, where=[filled(_resource())], sort=sort)


def cost_by_resource_principal_tags(
    bill: DataFrame,
    tags: Mapping[str, str],
    period: Period = None,
    tags_column: str = "resource_tags",
    sort: bool = True,
) -> DataFrame:
    """Cost by resource, principal, service and chosen tags, one column each.

    ``tags`` maps the output column to the tag key.
    """
    dims = {
        "resource_id": _resource(),
        "iam_principal": _any_principal(),
        "service": _service(),
        **_tag_dims(tags, tags_column),
    }
    return cost_report(bill, dims, period=period, where=[filled(_resource())], sort=sort)


def three_dims(
    bill: DataFrame,
    tags: Mapping[str, str],
    period: Period = None,
    tags_column: str = "resource_tags",
    sort: bool = True,
) -> DataFrame:
    """Cost by resource, principal and chosen tags, whatever the service."""
    dims = {
        "resource_id": _resource(),
        "iam_principal": _any_principal(),
        **_tag_dims(tags, tags_column),
    }
    return cost_report(bill, dims, period=period, where=[filled(_resource())], sort=sort)


def cost_by_tag_principal(
    bill: DataFrame,
    key: str,
    period: Period = None,
    tags_column: str = "resource_tags",
    tag_name: str = "tag_value",
    sort: bool = True,
) -> DataFrame:
    """Cost by one tag and principal, with the number of resource ids.

    No filter on resources: a blank id counts as one resource, NULL as none.
    """
    dims = {
        tag_name: or_placeholder(tag(F.col(tags_column), key), UNTAGGED),
        "iam_principal": _any_principal(),
    }
    measures = {"cost_usd": cost(), "distinct_resources": distinct_resources()}
    return cost_report(bill, dims, measures, period, sort=sort)


def panorama_short_dims() -> Dims:
    return {
        "resource_id": or_placeholder(_resource(), NO_RESOURCE),
        "iam_principal": _any_principal(),
        "service": _service(),
        "charge_type": _charge_type(),
    }


def panorama_dims(
    tags: Mapping[str, str] = PANORAMA_TAGS, tags_column: str = "resource_tags"
) -> Dims:
    return {
        **panorama_short_dims(),
        "region": or_placeholder(F.col("product_region_code"), NOTHING),
        **_tag_dims(tags, tags_column),
    }


def panorama(
    bill: DataFrame,
    period: Period = None,
    tags: Mapping[str, str] = PANORAMA_TAGS,
    tags_column: str = "resource_tags",
    sort: bool = True,
) -> DataFrame:
    """Cost in all dimensions, without any filter: adds up to the bill."""
    return cost_report(bill, panorama_dims(tags, tags_column), period=period, sort=sort)


def panorama_short(
    bill: DataFrame, period: Period = None, sort: bool = True
) -> DataFrame:
    """The panorama without region and tags; adds up to the bill as well."""
    return cost_report(bill, panorama_short_dims(), period=period, sort=sort)


def grand_total(bill: DataFrame, period: Period = None) -> DataFrame:
    """Total cost and number of lines: one row."""
    measures = {"grand_total_usd": cost(), "raw_line_items": lines()}
    return cost_report(bill, {}, measures, period, sort=False)


def no_resource_cost(bill: DataFrame, period: Period = None, sort: bool = True) -> DataFrame:
    """What the lines without resource id are, by charge type and service."""
    return cost_report(
        bill,
        {"charge_type": _charge_type(), "service": _service()},
        period=period,
        where=[is_blank(_resource())],
        sort=sort,
    )
