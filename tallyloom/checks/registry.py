"""All queries of the library on the bill made of order tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.checks.order_bill import BILL_COLUMNS, order_bill
from tallyloom.checks.stored_bill import STORED_QUERIES
from tallyloom.functions.columns import or_placeholder
from tallyloom.operators.periods import missing_periods, partition_values
from tallyloom.operators.profile import column_profile, preview, row_order
from tallyloom.operators.sql import sql_report
from tallyloom.plans import adjust, rank, reconcile, reports
from tallyloom.plans.commitments import usage_in_terms
from tallyloom.plans.spans import idle_gaps, usage_spans
from tallyloom.plans.subtotals import rolled_up, subtotals
from tallyloom.plans.tags_as_of import cost_by_tag_as_of
from tallyloom.plans.trends import month_over_month, running_costs
from tallyloom.sources.bill import Period
from tallyloom.sources.conform import conform

MONTH = "1997-06"
YEAR = ("1997-01", "1997-12")
RESOURCE = "res/16"
SERVICE = "ECONOMY"
FIRST_EXPECTED, LAST_EXPECTED = "1995-01", "2002-06"
TOP = 20
TAGS = {
    "tag_project": "user_project",
    "tag_owner": "user_owner",
    "tag_name": "user_name",
}
TWO_TAGS = {"tag_project": "user_project", "tag_owner": "user_owner"}
USAGE_ONLY_RULES = {
    **adjust.AMORTIZED_RULES,
    "SavingsPlanRecurringFee": None,
    "SavingsPlanNegation": None,
}

PERIOD = "billing_period"
COST = "line_item_unblended_cost"
RES = "line_item_resource_id"
PRIN = "line_item_iam_principal"
SVC = "line_item_product_code"
TYPE = "line_item_line_item_type"
USAGE_TYPE = "line_item_usage_type"
OPERATION = "line_item_operation"
REGION = "product_region_code"
AMOUNT = "line_item_usage_amount"
DATE = "line_item_usage_start_date"
END = "line_item_usage_end_date"
TAG_MAP = "resource_tags"
PLAIN_TAGS = "tags"
PLAN_COLUMNS = (
    "savings_plan_savings_plan_a_r_n",
    "savings_plan_start_time",
    "savings_plan_end_time",
)
UNUSED_COSTS = (
    "savings_plan_total_commitment_to_date",
    "savings_plan_used_commitment",
    "reservation_unused_amortized_upfront_fee_for_billing_period",
    "reservation_unused_recurring_fee",
)
SP_COST = "savings_plan_savings_plan_effective_cost"
RI_COST = "reservation_effective_cost"

AD_HOC_SQL = """
SELECT line_item_product_code AS service,
       CAST(CAST(SUM(CAST(line_item_unblended_cost AS DECIMAL(28,12)))
            AS DECIMAL(28,6)) AS DOUBLE) AS cost_usd
FROM {bill}
GROUP BY 1
ORDER BY cost_usd DESC, service
LIMIT 5
"""


def _unused_rules() -> adjust.Rules:
    """Usage with the fees that were paid for nothing, each where it is charged."""
    return {
        **adjust.AMORTIZED_RULES,
        "DiscountedUsage": adjust.sum_of(RI_COST, *UNUSED_COSTS[2:]),
        "SavingsPlanRecurringFee": adjust.unused_commitment(),
    }


def _subtotal_dims() -> dict[str, Column]:
    return {
        "service": F.col(SVC),
        "charge_type": F.col(TYPE),
        "region": or_placeholder(F.col(REGION), "-"),
        "iam_principal": or_placeholder(F.col(PRIN), "(no principal)"),
    }


Report = Callable[[DataFrame, Period], DataFrame]
Query = Callable[[SparkSession, str], DataFrame]

# Each report with the columns it reads besides period and cost.
REPORTS: Mapping[str, tuple[Report, tuple[str, ...]]] = {
    "cost_by_resource": (reports.cost_by_resource, (RES, SVC, REGION)),
    "resource_detail": (
        lambda bill, period: reports.resource_detail(bill, RESOURCE, period),
        (RES, SVC, USAGE_TYPE, OPERATION, TYPE, AMOUNT),
    ),
    "cost_by_resource_day": (reports.cost_by_resource_day, (RES, DATE)),
    "cost_by_service": (reports.cost_by_service, (SVC,)),
    "service_drilldown": (
        lambda bill, period: reports.service_drilldown(bill, SERVICE, period),
        (RES, SVC, USAGE_TYPE, OPERATION, AMOUNT),
    ),
    "usage_cost_by_resource": (reports.usage_cost_by_resource, (RES, SVC, TYPE)),
    "cost_by_tag": (
        lambda bill, period: reports.cost_by_tag(
            bill, "user_project", period, tag_name="project_tag"
        ),
        (TAG_MAP,),
    ),
    "cost_by_plain_tag": (
        lambda bill, period: reports.cost_by_tag(
            bill, "env", period, tags_column=PLAIN_TAGS, tag_name="env"
        ),
        (PLAIN_TAGS,),
    ),
    "cost_by_resource_principal": (
        reports.cost_by_resource_principal,
        (RES, PRIN, SVC),
    ),
    "cost_by_resource_any_principal": (
        reports.cost_by_resource_any_principal,
        (RES, PRIN, SVC),
    ),
    "cost_by_principal": (reports.cost_by_principal, (RES, PRIN)),
    "tag_keys": (reports.tag_keys, (TAG_MAP,)),
    "cost_by_resource_principal_tags": (
        lambda bill, period: reports.cost_by_resource_principal_tags(bill, TAGS, period),
        (RES, PRIN, SVC, TAG_MAP),
    ),
    "cost_by_tag_principal": (
        lambda bill, period: reports.cost_by_tag_principal(
            bill, "user_owner", period, tag_name="tag_owner"
        ),
        (RES, PRIN, TAG_MAP),
    ),
    "tag_total": (reports.tag_total, (RES, PRIN, TAG_MAP)),
    "tag_total_plain": (
        lambda bill, period: reports.tag_total(bill, period, tags_column=PLAIN_TAGS),
        (RES, PRIN, PLAIN_TAGS),
    ),
    "panorama": (reports.panorama, (RES, PRIN, SVC, TYPE, REGION, TAG_MAP)),
    "grand_total": (reports.grand_total, ()),
    "no_resource_cost": (reports.no_resource_cost, (RES, SVC, TYPE)),
    "principal_cost_any_resource": (reports.principal_cost_any_resource, (RES, PRIN)),
    "three_dims": (
        lambda bill, period: reports.three_dims(bill, TWO_TAGS, period),
        (RES, PRIN, TAG_MAP),
    ),
    "panorama_short": (reports.panorama_short, (RES, PRIN, SVC, TYPE)),
    "reconcile": (reconcile.reconcile, (RES, PRIN, SVC, TYPE, REGION, TAG_MAP)),
    "unattributed_share": (reconcile.unattributed_share, (RES,)),
    "no_resource_by_type": (reconcile.no_resource_by_type, (RES, TYPE)),
    "savings_plan_net": (adjust.savings_plan_net, (TYPE,)),
    "amortized_cost": (adjust.amortized_cost, (SVC, TYPE, SP_COST, RI_COST)),
    "amortized_usage_cost": (
        lambda bill, period: adjust.amortized_cost(bill, period, rules=USAGE_ONLY_RULES),
        (SVC, TYPE, SP_COST, RI_COST),
    ),
    "amortized_unused_cost": (
        lambda bill, period: adjust.amortized_cost(bill, period, rules=_unused_rules()),
        (SVC, TYPE, SP_COST, RI_COST, *UNUSED_COSTS),
    ),
    "amortized_total": (
        lambda bill, period: adjust.amortized_cost(bill, period, dims={}),
        (TYPE, SP_COST, RI_COST),
    ),
    "dimension_coverage": (reconcile.dimension_coverage, (RES, PRIN, TAG_MAP)),
    "top_resources": (
        lambda bill, period: rank.top_resources(bill, TOP, period),
        (RES, SVC, REGION),
    ),
    "shared_resources": (rank.shared_resources, (RES, PRIN)),
    "cost_by_tag_as_of": (
        lambda bill, period: cost_by_tag_as_of(bill, "user_project", period),
        (RES, DATE, TAG_MAP),
    ),
    "usage_in_terms": (
        lambda bill, period: usage_in_terms(bill, period=period),
        (SVC, USAGE_TYPE, TYPE, DATE, *PLAN_COLUMNS),
    ),
    "subtotals": (
        lambda bill, period: subtotals(bill, _subtotal_dims(), period),
        (PRIN, SVC, TYPE, REGION),
    ),
    "subtotals_rolled_up": (
        lambda bill, period: subtotals(bill, _subtotal_dims(), period, rolled_up(_subtotal_dims())),
        (PRIN, SVC, TYPE, REGION),
    ),
    "running_costs": (running_costs, (RES, DATE)),
    "month_over_month": (
        lambda bill, period: month_over_month(
            bill, {"service": F.col(SVC), "charge_type": F.col(TYPE)}, period
        ),
        (SVC, TYPE),
    ),
    "usage_spans": (usage_spans, (RES, DATE, END)),
    "idle_gaps": (idle_gaps, (RES, DATE, END)),
}

# Queries that look at the bill as a whole and take no period.
_WHOLE_BILL: Mapping[str, tuple[Callable[[DataFrame], DataFrame], tuple[str, ...]]] = {
    "missing_periods": (
        lambda bill: missing_periods(bill, FIRST_EXPECTED, LAST_EXPECTED),
        (PERIOD,),
    ),
    "partition_values": (partition_values, (PERIOD,)),
    "column_profile": (column_profile, BILL_COLUMNS),
    "conformed_profile": (lambda bill: column_profile(conform(bill)), BILL_COLUMNS),
    "conformed_resource_day": (
        lambda bill: reports.cost_by_resource_day(conform(bill)),
        (PERIOD, COST, RES, DATE),
    ),
    "preview": (lambda bill: _first_lines(bill), BILL_COLUMNS),
    "adhoc_top_services": (lambda bill: sql_report(bill, AD_HOC_SQL), (SVC, COST)),
}


def _first_lines(bill: DataFrame) -> DataFrame:
    """Ten lines in the order of all columns; tags as text, in order."""
    first = preview(bill, order=row_order(bill))
    entries = {
        name: F.array_join(
            F.transform(
                F.array_sort(F.map_entries(name)),
                lambda entry: F.concat_ws("=", entry["key"], entry["value"]),
            ),
            ",",
        )
        for name in (TAG_MAP, PLAIN_TAGS)
    }
    return first.withColumns(entries)


def _report_query(name: str, period: Period) -> Query:
    report, columns = REPORTS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bill = order_bill(spark, sf_dir, (PERIOD, COST, *columns), period)
        return report(bill, period)

    return run


def _whole_bill_query(name: str) -> Query:
    operator, columns = _WHOLE_BILL[name]
    return lambda spark, sf_dir: operator(order_bill(spark, sf_dir, columns))


def all_queries() -> dict[str, Query]:
    """Every report over the whole bill and for one month, and the rest."""
    found = {name: _whole_bill_query(name) for name in _WHOLE_BILL}
    for name in REPORTS:
        found[name] = _report_query(name, None)
        found[f"{name}_month"] = _report_query(name, MONTH)
    found["cost_by_service_year"] = _report_query("cost_by_service", YEAR)
    return found | STORED_QUERIES
