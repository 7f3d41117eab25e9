"""The same queries in DuckDB SQL, written from the definition of the reports.

One step settles every blank value of the chosen lines; a report is a grouping of
the settled lines.
"""

from __future__ import annotations

from tallyloom.checks.registry import MONTH, YEAR
from tallyloom.sources.bill_schema import BILL_SCHEMA

_BILL = """
WITH bill AS (
  SELECT
    strftime(l_shipdate, '%Y-%m') AS billing_period,
    l_shipdate + to_hours(CAST(l_orderkey % 24 AS INT)) AS line_item_usage_start_date,
    CASE WHEN l_partkey % 10 <= 2 THEN ''
         WHEN l_partkey % 10 = 3 THEN NULL
         ELSE 'res/' || (l_partkey % 40) END AS line_item_resource_id,
    CASE l_linenumber
         WHEN 1 THEN 'Usage' WHEN 2 THEN 'DiscountedUsage'
         WHEN 3 THEN 'SavingsPlanCoveredUsage' WHEN 4 THEN 'SavingsPlanRecurringFee'
         WHEN 5 THEN 'SavingsPlanNegation' WHEN 6 THEN 'Tax'
         ELSE 'Credit' END AS line_item_line_item_type,
    p_type AS line_item_product_code,
    p_brand AS line_item_usage_type,
    l_returnflag AS line_item_operation,
    CASE n_regionkey WHEN 0 THEN '' WHEN 1 THEN NULL
         ELSE 'region-' || n_regionkey END AS product_region_code,
    CASE o_orderstatus WHEN 'P' THEN '' WHEN 'F' THEN NULL
         ELSE 'user/' || (o_custkey % 5) END AS line_item_iam_principal,
    l_quantity AS line_item_usage_amount,
    CASE WHEN l_linenumber IN (5, 7) THEN -l_extendedprice
         ELSE l_extendedprice END AS line_item_unblended_cost,
    CASE WHEN l_linenumber = 3
         THEN CAST(CAST(l_extendedprice AS DECIMAL(15,2))
                   * (1 - CAST(l_discount AS DECIMAL(15,2))) AS DOUBLE)
         ELSE 0 END AS savings_plan_savings_plan_effective_cost,
    CASE WHEN l_linenumber = 2
         THEN CAST(CAST(l_extendedprice AS DECIMAL(15,2))
                   * (1 - CAST(l_discount AS DECIMAL(15,2))) AS DOUBLE)
         ELSE 0 END AS reservation_effective_cost,
    CASE WHEN l_linenumber = 4 THEN l_extendedprice END
      AS savings_plan_total_commitment_to_date,
    CASE WHEN l_linenumber = 4
         THEN CAST(CAST(l_extendedprice AS DECIMAL(15,2))
                   * (1 - CAST(l_discount AS DECIMAL(15,2))) AS DOUBLE)
         ELSE 0 END AS savings_plan_used_commitment,
    CASE WHEN l_linenumber = 2
         THEN CAST(CAST(l_extendedprice AS DECIMAL(15,2))
                   * CAST(l_discount AS DECIMAL(15,2)) AS DOUBLE)
         ELSE 0 END AS reservation_unused_recurring_fee,
    CASE WHEN l_linenumber = 2 AND l_partkey % 2 = 1 THEN l_quantity END
      AS reservation_unused_amortized_upfront_fee_for_billing_period,
    [CAST(l_orderkey AS BIGINT), l_linenumber, l_partkey, l_suppkey,
     CAST(ROUND(100 * l_extendedprice) AS BIGINT), CAST(l_quantity AS BIGINT),
     CAST(strftime(l_shipdate, '%Y%m%d') AS BIGINT)] AS line_id,
    l_shipdate + to_hours(CAST(l_orderkey % 24 + 1 + l_quantity % 8 AS INT))
      AS line_item_usage_end_date,
    CASE WHEN l_linenumber = 4 THEN 'plan/' || (l_partkey % 12) END AS plan,
    date_trunc('month', l_shipdate) AS plan_start,
    date_trunc('month', l_shipdate) + to_months(CAST(1 + l_partkey % 3 AS INT)) AS plan_end,
    CASE WHEN l_suppkey % 10 <> 0 THEN map_from_entries(list_filter([
      {'key': 'user_project',
       'value': CASE l_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ''
                ELSE 'project/' || (l_partkey % 3) END},
      {'key': 'user_owner',
       'value': CASE WHEN l_suppkey % 3 = 0 THEN NULL
                ELSE 'owner/' || (l_partkey % 4) END},
      {'key': 'user_name',
       'value': CASE WHEN l_suppkey % 5 = 1 THEN NULL ELSE p_type END},
      {'key': 'user_parallelcluster_cluster_name',
       'value': CASE WHEN l_suppkey % 7 = 1
                THEN 'cluster/' || (l_partkey % 2) END}
    ], lambda x: x.value IS NOT NULL)) END AS resource_tags,
    CASE WHEN l_suppkey % 6 <> 0 THEN map_from_entries(list_filter([
      {'key': 'env',
       'value': CASE l_suppkey % 4 WHEN 1 THEN NULL WHEN 2 THEN ''
                ELSE 'env/' || (l_partkey % 3) END},
      {'key': 'team',
       'value': CASE WHEN l_suppkey % 5 = 0 THEN 'team/' || (l_partkey % 2) END}
    ], lambda x: x.value IS NOT NULL)) END AS tags
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN nation ON s_nationkey = n_nationkey
)"""


# The chosen lines, each blank value settled once: a placeholder stands for it in
# the ``any_`` columns, and it is nothing but false for the ``has_`` columns.
_SETTLED = {
    "any_resource": ("line_item_resource_id", "(no resource id)"),
    "any_principal": ("line_item_iam_principal", "(no principal)"),
    "any_region": ("product_region_code", "-"),
    "project": ("resource_tags['user_project']", "-"),
    "owner": ("resource_tags['user_owner']", "-"),
    "name": ("resource_tags['user_name']", "-"),
    "cluster": ("resource_tags['user_parallelcluster_cluster_name']", "-"),
}
_LINES = (
    ", lines AS (SELECT *, "
    + ", ".join(
        f"CASE WHEN {value} > '' THEN {value} ELSE '{blank}' END AS {name}"
        for name, (value, blank) in _SETTLED.items()
    )
    + """,
    any_resource = line_item_resource_id AS has_resource,
    any_principal = line_item_iam_principal AS has_principal,
    CAST(line_item_unblended_cost AS DECIMAL(28,12)) AS exact_cost
  FROM bill WHERE {when})
"""
)

_RESOURCE = {"resource_id": "line_item_resource_id"}
_PRINCIPAL = {"iam_principal": "line_item_iam_principal"}
_ANY_PRINCIPAL = {"iam_principal": "any_principal"}
_SERVICE = {"service": "line_item_product_code"}
_TYPE = {"charge_type": "line_item_line_item_type"}
_USE = {"usage_type": "line_item_usage_type", "operation": "line_item_operation"}
_FOUR = {"resource_id": "any_resource", **_ANY_PRINCIPAL, **_SERVICE, **_TYPE}
_NINE = {
    **_FOUR,
    "region": "any_region",
    "tag_project": "project",
    "tag_owner": "owner",
    "tag_name": "name",
    "tag_cluster": "cluster",
}


def _usd(exact: str = "exact_cost") -> str:
    """Money as shown: summed exactly, then rounded to six digits."""
    return f"CAST(CAST(SUM({exact}) AS DECIMAL(28,6)) AS DOUBLE)"


def _decimal(amount: str) -> str:
    return f"CAST({amount} AS DECIMAL(28,12))"


_USAGE = f"CAST(SUM({_decimal('line_item_usage_amount')}) AS DOUBLE)"
_RESOURCES = "COUNT(DISTINCT line_item_resource_id)"


def _grouped(
    dims: dict[str, str], measures: dict[str, str] | None = None, where: str = "TRUE", of: str = "lines"
) -> str:
    """A report: lines that fulfil the condition, by dimension, with their cost."""
    shown = {**dims, "cost_usd": _usd()} | (measures or {})
    columns = ", ".join(f"{value} AS {name}" for name, value in shown.items())
    keys = ", ".join(str(number + 1) for number in range(len(dims)))
    return f"SELECT {columns} FROM {of} WHERE {where}" + (f" GROUP BY {keys}" if keys else "")


def _amortized(rules: dict[str, str], dims: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{kind}' THEN {amount}" for kind, amount in rules.items())
    amount = f"CASE line_item_line_item_type {cases} ELSE line_item_unblended_cost END"
    return _grouped(dims, {"amortized_usd": _usd(_decimal(amount))})


_EFFECTIVE = {
    "SavingsPlanCoveredUsage": "savings_plan_savings_plan_effective_cost",
    "DiscountedUsage": "reservation_effective_cost",
}
_NO_FEES = {"SavingsPlanRecurringFee": "0", "SavingsPlanNegation": "0"}
_UNUSED = {
    "DiscountedUsage": """0 + COALESCE(reservation_effective_cost, 0)
      + COALESCE(reservation_unused_amortized_upfront_fee_for_billing_period, 0)
      + COALESCE(reservation_unused_recurring_fee, 0)""",
    "SavingsPlanRecurringFee": """COALESCE(savings_plan_total_commitment_to_date, 0)
      - COALESCE(savings_plan_used_commitment, 0)""",
}
_USED = "('Usage', 'DiscountedUsage', 'SavingsPlanCoveredUsage')"
_PLAN = {
    "recurring_fee_usd": "SavingsPlanRecurringFee",
    "negation_usd": "SavingsPlanNegation",
    "covered_usage_usd": "SavingsPlanCoveredUsage",
}


def _of_tags(tags: str) -> str:
    entry = f"SELECT *, UNNEST(map_entries({tags})) AS tag FROM lines"
    dims = {**_RESOURCE, **_ANY_PRINCIPAL, "tag_key": "tag.key", "tag_value": "tag.value"}
    return _grouped(dims, where="has_resource", of=f"({entry})")


# {when} in the lines stands for the condition on the billing period.
_REPORTS = {
    "cost_by_resource": _grouped(
        {**_RESOURCE, **_SERVICE, "region": "product_region_code"}, where="has_resource"
    ),
    "resource_detail": _grouped(
        {**_RESOURCE, **_SERVICE, **_USE, **_TYPE},
        {"usage_amount": _USAGE},
        "any_resource = 'res/16'",
    ),
    "cost_by_resource_day": _grouped(
        {"usage_date": "CAST(line_item_usage_start_date AS DATE)", **_RESOURCE},
        where="has_resource",
    ),
    "cost_by_service": _grouped(_SERVICE),
    "service_drilldown": _grouped(
        {**_RESOURCE, **_USE}, {"usage_amount": _USAGE}, "line_item_product_code = 'ECONOMY'"
    ),
    "usage_cost_by_resource": _grouped(
        {**_RESOURCE, **_SERVICE},
        where=f"has_resource AND line_item_line_item_type IN {_USED}",
    ),
    "cost_by_tag": _grouped({"project_tag": "resource_tags['user_project']"}),
    "cost_by_plain_tag": _grouped({"env": "tags['env']"}),
    "cost_by_resource_principal": _grouped(
        {**_RESOURCE, **_PRINCIPAL, **_SERVICE}, where="has_resource AND has_principal"
    ),
    "cost_by_resource_any_principal": _grouped(
        {**_RESOURCE, **_ANY_PRINCIPAL, **_SERVICE}, where="has_resource"
    ),
    "cost_by_principal": _grouped(
        _PRINCIPAL, {"distinct_resources": _RESOURCES}, "has_principal"
    ),
    "tag_keys": _grouped(
        {"tag_key": "key"},
        {"rows_cnt": "COUNT(*)"},
        of="(SELECT *, UNNEST(map_keys(resource_tags)) AS key FROM lines)",
    ),
    "cost_by_resource_principal_tags": _grouped(
        {
            **_RESOURCE, **_ANY_PRINCIPAL, **_SERVICE,
            "tag_project": "project", "tag_owner": "owner", "tag_name": "name",
        },
        where="has_resource",
    ),
    "cost_by_tag_principal": _grouped(
        {
            "tag_owner": "CASE owner WHEN '-' THEN '(untagged)' ELSE owner END",
            **_ANY_PRINCIPAL,
        },
        {"distinct_resources": _RESOURCES},
    ),
    "tag_total": _of_tags("resource_tags"),
    "tag_total_plain": _of_tags("tags"),
    "panorama": _grouped(_NINE),
    "grand_total": f"SELECT {_usd()} AS grand_total_usd, COUNT(*) AS raw_line_items FROM lines",
    "no_resource_cost": _grouped({**_TYPE, **_SERVICE}, where="has_resource IS NOT TRUE"),
    "principal_cost_any_resource": _grouped({**_RESOURCE, **_PRINCIPAL}, where="has_principal"),
    "three_dims": _grouped(
        {**_RESOURCE, **_ANY_PRINCIPAL, "tag_project": "project", "tag_owner": "owner"},
        where="has_resource",
    ),
    "panorama_short": _grouped(_FOUR),
    "reconcile": f"""
, report AS (
  SELECT SUM(exact_cost) AS cost, COUNT(*) AS lines
  FROM lines GROUP BY {', '.join(_NINE.values())}
), of_report AS (
  SELECT SUM(cost) AS cost, COUNT(*) AS groups, CAST(SUM(lines) AS BIGINT) AS lines
  FROM report
), of_bill AS (
  SELECT SUM(exact_cost) AS cost, COUNT(*) AS lines FROM lines
)
SELECT CAST(CAST(of_report.cost AS DECIMAL(28,6)) AS DOUBLE) AS report_total_usd,
       CAST(CAST(of_bill.cost AS DECIMAL(28,6)) AS DOUBLE) AS grand_total_usd,
       CAST(of_report.cost - of_bill.cost AS DOUBLE) AS difference_usd,
       groups AS report_groups, of_report.lines AS report_lines,
       of_bill.lines AS raw_line_items
FROM of_report, of_bill""",
    "unattributed_share": f"""
, parts AS (
  SELECT {_usd()} AS grand_total_usd,
         {_usd("CASE WHEN has_resource THEN exact_cost ELSE 0 END")} AS attributed_usd,
         {_usd("CASE WHEN has_resource THEN 0 ELSE exact_cost END")} AS unattributed_usd
  FROM lines
)
SELECT *, CASE WHEN grand_total_usd <> 0 THEN unattributed_usd / grand_total_usd END
  AS unattributed_share
FROM parts""",
    "no_resource_by_type": f"""
SELECT charge_type, charge_type IS NULL AS is_total, cost_usd FROM (
  {_grouped(_TYPE, where="has_resource IS NOT TRUE")}
  UNION ALL {_grouped({"charge_type": "NULL"}, where="has_resource IS NOT TRUE")})""",
    "savings_plan_net": (
        "SELECT billing_period, "
        + ", ".join(
            _usd(f"CASE line_item_line_item_type WHEN '{kind}' THEN exact_cost ELSE 0 END")
            + f" AS {name}"
            for name, kind in _PLAN.items()
        )
        + f", {_usd()} AS net_usd FROM lines"
        + f" WHERE line_item_line_item_type IN {tuple(_PLAN.values())} GROUP BY 1"
    ),
    "amortized_cost": _amortized(_EFFECTIVE, {**_SERVICE, **_TYPE}),
    "amortized_usage_cost": _amortized(_EFFECTIVE | _NO_FEES, {**_SERVICE, **_TYPE}),
    "amortized_unused_cost": _amortized(_EFFECTIVE | _UNUSED, {**_SERVICE, **_TYPE}),
    "amortized_total": _amortized(_EFFECTIVE, {}),
    "dimension_coverage": _grouped(
        {
            "has_resource": "has_resource IS TRUE",
            "has_principal": "has_principal IS TRUE",
            "has_tag": "COALESCE(cardinality(resource_tags), 0) > 0",
        },
        {"lines": "COUNT(*)"},
        of="lines AS l",
    ).replace("GROUP BY 1, 2, 3", "GROUP BY ALL"),
    "top_resources": f"""
, costs AS ({_grouped({**_RESOURCE, **_SERVICE, "region": "product_region_code"}, where="has_resource")})
SELECT ROW_NUMBER() OVER (
         ORDER BY cost_usd DESC, resource_id, service, region NULLS LAST) AS rank, *
FROM costs ORDER BY rank LIMIT 20""",
    "shared_resources": f"""
, pairs AS (
  SELECT any_resource AS resource_id, any_principal AS iam_principal, SUM(exact_cost) AS cost
  FROM lines WHERE has_resource AND has_principal GROUP BY 1, 2
), whole AS (
  SELECT resource_id, COUNT(*) AS principals, {_usd("cost")} AS resource_cost_usd
  FROM pairs GROUP BY 1 HAVING COUNT(*) > 1
)
SELECT resource_id, iam_principal, {_usd("cost")} AS cost_usd, resource_cost_usd, principals,
       CASE WHEN resource_cost_usd <> 0 THEN {_usd("cost")} / resource_cost_usd END AS cost_share
FROM pairs JOIN whole USING (resource_id)
GROUP BY resource_id, iam_principal, resource_cost_usd, principals""",
}

_CUBE = "line_item_product_code, line_item_line_item_type, any_region, any_principal"


def _subtotals(grouping: str) -> str:
    """All subtotals of four dimensions, with the bits of those that are summed over."""
    return f"""
SELECT GROUPING({_CUBE}) AS level, line_item_product_code AS service,
       line_item_line_item_type AS charge_type, any_region AS region,
       any_principal AS iam_principal, {_usd()} AS cost_usd, COUNT(*) AS lines
FROM lines GROUP BY {grouping}({_CUBE})"""


# Uses of a resource with the latest end of those that began before.
_USES = """
, uses AS (
  SELECT any_resource AS resource_id, line_item_usage_start_date AS use_begin,
         MAX(line_item_usage_end_date) AS use_end
  FROM lines WHERE has_resource GROUP BY 1, 2
), in_order AS (
  SELECT *, MAX(use_end) OVER (
    PARTITION BY resource_id ORDER BY use_begin
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM uses
)"""
_HOURS = "EPOCH({late}) / 3600 - EPOCH({early}) / 3600"


_OVER_TIME = {
    "cost_by_tag_as_of": f"""
, tagged AS (
  SELECT any_resource AS resource_id, line_item_usage_start_date AS tagged_at,
         MAX(project) AS tag
  FROM lines WHERE has_resource AND project <> '-' GROUP BY 1, 2
), found AS (
  SELECT lines.*, CASE WHEN has_resource THEN tag END AS earlier
  FROM lines ASOF LEFT JOIN tagged
  ON any_resource = tagged.resource_id AND line_item_usage_start_date >= tagged_at
)
SELECT CASE project WHEN '-' THEN earlier ELSE project END AS tag_value,
       CASE WHEN project <> '-' THEN 'own' WHEN earlier IS NULL THEN 'none'
            ELSE 'earlier' END AS tag_from,
       {_usd()} AS cost_usd, COUNT(*) AS lines
FROM found GROUP BY 1, 2""",
    "usage_in_terms": f"""
, terms AS (
  SELECT DISTINCT plan, line_item_product_code AS service,
         line_item_usage_type AS usage_type, plan_start, plan_end
  FROM lines WHERE plan IS NOT NULL
)
SELECT terms.plan AS commitment, service, usage_type, terms.plan_start AS term_start,
       terms.plan_end AS term_end, {_usd()} AS cost_usd, COUNT(*) AS lines
FROM lines JOIN terms
  ON line_item_product_code = service AND line_item_usage_type = usage_type
 AND line_item_usage_start_date >= terms.plan_start
 AND line_item_usage_start_date < terms.plan_end
WHERE line_item_line_item_type IN ('Usage', 'SavingsPlanCoveredUsage')
GROUP BY ALL""",
    "subtotals": _subtotals("CUBE"),
    "subtotals_rolled_up": _subtotals("ROLLUP"),
    "running_costs": f"""
, daily AS (
  SELECT any_resource AS resource_id, CAST(line_item_usage_start_date AS DATE) AS usage_date,
         SUM(exact_cost) AS cost
  FROM lines WHERE has_resource GROUP BY 1, 2
), calendar AS (
  SELECT resource_id, CAST(UNNEST(generate_series(
    MIN(usage_date)::TIMESTAMP, MAX(usage_date)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS usage_date
  FROM daily GROUP BY 1
), dense AS (
  SELECT resource_id, usage_date, COALESCE(cost, 0) AS cost
  FROM calendar LEFT JOIN daily USING (resource_id, usage_date)
)
SELECT resource_id, usage_date,
       CAST(CAST(cost AS DECIMAL(28,6)) AS DOUBLE) AS cost_usd,
       CAST(CAST(week AS DECIMAL(28,6)) AS DOUBLE) AS cost_7_days_usd,
       CAST(CAST(month AS DECIMAL(28,6)) AS DOUBLE) AS cost_30_days_usd
FROM (
  SELECT *, SUM(cost) OVER (PARTITION BY resource_id ORDER BY usage_date
              RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS week,
         SUM(cost) OVER (PARTITION BY resource_id ORDER BY usage_date
              RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) AS month
  FROM dense)""",
    "month_over_month": """
, monthly AS (
  SELECT line_item_product_code AS service, line_item_line_item_type AS charge_type,
         CAST(billing_period || '-01' AS DATE) AS month, SUM(exact_cost) AS cost
  FROM lines GROUP BY 1, 2, 3
), calendar AS (
  SELECT service, charge_type, CAST(UNNEST(generate_series(
    MIN(month)::TIMESTAMP, MAX(month)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS month
  FROM monthly GROUP BY 1, 2
), dense AS (
  SELECT c.service, c.charge_type, c.month, COALESCE(cost, 0) AS cost
  FROM calendar c LEFT JOIN monthly m
    ON c.service IS NOT DISTINCT FROM m.service
   AND c.charge_type IS NOT DISTINCT FROM m.charge_type AND c.month = m.month
), paired AS (
  SELECT *, LAG(cost) OVER (PARTITION BY service, charge_type ORDER BY month) AS before
  FROM dense
), shown AS (
  SELECT service, charge_type, strftime(month, '%Y-%m') AS billing_period,
         CAST(CAST(cost AS DECIMAL(28,6)) AS DOUBLE) AS cost_usd,
         CAST(CAST(before AS DECIMAL(28,6)) AS DOUBLE) AS before_usd,
         CAST(CAST(cost - before AS DECIMAL(28,6)) AS DOUBLE) AS change_usd
  FROM paired
)
SELECT *, CASE WHEN before_usd <> 0 THEN change_usd / before_usd END AS change_share
FROM shown""",
    "usage_spans": _USES
    + f"""
, sums AS (
  SELECT resource_id, MIN(use_begin) AS first_use, MAX(use_end) AS last_use,
         1 + COUNT(*) FILTER (WHERE use_begin > before) AS spans,
         COALESCE(SUM(EPOCH(use_begin) - EPOCH(before)) FILTER (WHERE use_begin > before), 0)
           / 3600 AS hours_idle
  FROM in_order GROUP BY 1
)
SELECT *, {_HOURS.format(late="last_use", early="first_use")} - hours_idle AS hours_used
FROM sums""",
    "idle_gaps": _USES
    + f"""
SELECT resource_id, before AS idle_from, use_begin AS idle_until,
       {_HOURS.format(late="use_begin", early="before")} AS idle_hours
FROM in_order WHERE use_begin > before""",
}
_REPORTS.update(_OVER_TIME)

_DELIVERED = """
, was AS (
  SELECT line_id, exact_cost AS cost, line_item_line_item_type AS kind FROM lines
  WHERE line_item_line_item_type <> 'Credit'
), is_now AS (
  SELECT line_id, line_item_line_item_type AS kind,
         CASE line_item_line_item_type
           WHEN 'DiscountedUsage' THEN CAST(line_item_unblended_cost
             + line_item_usage_amount AS DECIMAL(28,12)) ELSE exact_cost END AS cost,
         CASE line_item_line_item_type WHEN 'SavingsPlanRecurringFee' THEN 2 ELSE 1 END AS copies
  FROM lines WHERE line_item_line_item_type <> 'Tax'
), moved AS (
  SELECT CASE WHEN is_now.kind IS NULL THEN 'removed' WHEN was.kind IS NULL THEN 'added'
              WHEN was.cost <> is_now.cost OR copies > 1 THEN 'changed' ELSE 'same' END AS kind,
         line_id, was.cost AS old_cost, is_now.cost AS new_cost, copies,
         was.cost = is_now.cost AS stays
  FROM was FULL JOIN is_now USING (line_id)
), parts AS (
  SELECT kind, line_id, CASE WHEN kind = 'added' OR stays THEN 0 ELSE 1 END AS old_lines,
         CASE WHEN kind = 'removed' THEN 0 WHEN stays THEN copies - 1 ELSE copies END AS new_lines,
         old_cost, new_cost
  FROM moved WHERE kind <> 'same'
  UNION ALL
  SELECT 'same', line_id, 1, 1, old_cost, new_cost FROM moved WHERE stays
)"""
_STORED = {
    "refreshed_months": _grouped(
        {"billing_period": "billing_period", **_SERVICE},
        {"lines": "COUNT(*)"},
        f"NOT (billing_period = '{MONTH}' AND line_item_line_item_type = 'Credit')",
    ),
    "sketched_years": f"""
SELECT substr(billing_period, 1, 4) AS year, COUNT(*) AS lines, {_usd()} AS cost_usd,
       COUNT(DISTINCT line_id) AS distinct_lines, TRUE AS distinct_within, TRUE AS ranks_within
FROM lines GROUP BY 1""",
    "sketched_payers": """
SELECT substr(billing_period, 1, 4) AS year, any_principal AS iam_principal, COUNT(*) AS lines
FROM lines WHERE has_principal GROUP BY 1, 2""",
    "streamed_cost": _grouped({**_SERVICE, **_TYPE}, {"lines": "COUNT(*)"}),
    "changes_of_refresh": _DELIVERED
    + f"""
SELECT kind, CAST(SUM(old_lines) AS BIGINT) AS old_lines,
       CAST(SUM(new_lines) AS BIGINT) AS new_lines,
       {_usd("COALESCE(old_cost, 0) * old_lines")} AS old_cost_usd,
       {_usd("COALESCE(new_cost, 0) * new_lines")} AS new_cost_usd,
       {_usd("COALESCE(new_cost, 0) * new_lines - COALESCE(old_cost, 0) * old_lines")}
         AS difference_usd
FROM parts GROUP BY 1""",
    "changed_lines": _DELIVERED
    + """
SELECT array_to_string(line_id, '-') AS line_id, kind, CAST(old_lines AS BIGINT) AS old_lines,
       CAST(new_lines AS BIGINT) AS new_lines,
       CAST(CAST(COALESCE(old_cost, 0) * old_lines AS DECIMAL(28,6)) AS DOUBLE)
         AS old_cost,
       CAST(CAST(COALESCE(new_cost, 0) * new_lines AS DECIMAL(28,6)) AS DOUBLE)
         AS new_cost
FROM parts WHERE kind <> 'same'""",
}

_MISSING_PERIODS = """
SELECT strftime(month, '%Y-%m') AS billing_period
FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2002-06-01', INTERVAL 1 MONTH)
  AS expected(month)
WHERE strftime(month, '%Y-%m') NOT IN (SELECT billing_period FROM bill)
ORDER BY 1"""

_PARTITION_VALUES = """
SELECT DISTINCT billing_period FROM bill ORDER BY billing_period"""

_ADHOC_TOP_SERVICES = _grouped(_SERVICE) + " ORDER BY cost_usd DESC, service LIMIT 5"

# Columns of the bill and their types, as Spark names them.
_BILL_TYPES = {
    "billing_period": "string",
    "line_item_usage_start_date": "timestamp_ntz",
    "line_item_resource_id": "string",
    "line_item_line_item_type": "string",
    "line_item_product_code": "string",
    "line_item_usage_type": "string",
    "line_item_operation": "string",
    "product_region_code": "string",
    "line_item_iam_principal": "string",
    "line_item_usage_amount": "double",
    "line_item_unblended_cost": "double",
    "savings_plan_savings_plan_effective_cost": "double",
    "reservation_effective_cost": "double",
    "savings_plan_total_commitment_to_date": "double",
    "savings_plan_used_commitment": "double",
    "reservation_unused_recurring_fee": "double",
    "reservation_unused_amortized_upfront_fee_for_billing_period": "double",
    "resource_tags": "map<string,string>",
    "tags": "map<string,string>",
}


def _preview_sql() -> str:
    """The first ten lines in the order of all columns, maps as sorted text."""
    columns = {
        name: f"array_to_string(list_sort(list_transform(map_entries({name}), "
        "lambda e: e.key || '=' || e.value)), ',')"
        if kind.startswith("map")
        else name
        for name, kind in _BILL_TYPES.items()
    }
    shown = ", ".join(f"{value} AS {name}" for name, value in columns.items())
    order = ", ".join(f"{number + 1} ASC NULLS FIRST" for number in range(len(columns)))
    return f"SELECT {shown} FROM bill ORDER BY {order} LIMIT 10"



def _profile_sql(types: dict[str, str]) -> str:
    """Profile of columns with the given types; those not in the bill are NULL."""
    counts, rows = [], []
    for name, kind in types.items():
        filled, blank = "0", "0"
        if name in _BILL_TYPES:
            counts.append(f"COUNT({name}) AS filled_{name}")
            filled = f"filled_{name}"
            if kind == "string":
                counts.append(f"COUNT(*) FILTER (WHERE {name} = '') AS blank_{name}")
                blank = f"blank_{name}"
        rows.append(
            f"SELECT '{name}' AS column_name, '{kind}' AS data_type, "
            f"{name == 'billing_period'} AS is_partition, row_count, "
            f"row_count - {filled} AS null_count, "
            f"CAST({blank} AS BIGINT) AS blank_count FROM counts"
        )
    return (
        f", counts AS (SELECT COUNT(*) AS row_count, {', '.join(counts)} FROM bill)\n"
        + "\nUNION ALL ".join(rows)
    )


def all_oracle_sql() -> dict[str, str]:
    """DuckDB SQL for every query with a determined result."""
    declared = {field.name: field.dataType.simpleString() for field in BILL_SCHEMA}
    every = _LINES.replace("{when}", "TRUE")
    month = _LINES.replace("{when}", f"billing_period = '{MONTH}'")
    year = _LINES.replace("{when}", f"billing_period BETWEEN '{YEAR[0]}' AND '{YEAR[1]}'")
    found = {
        "missing_periods": _MISSING_PERIODS,
        "partition_values": _PARTITION_VALUES,
        "preview": _preview_sql(),
        "adhoc_top_services": every + _ADHOC_TOP_SERVICES,
        "conformed_resource_day": every + _REPORTS["cost_by_resource_day"],
        "column_profile": _profile_sql(_BILL_TYPES),
        "conformed_profile": _profile_sql(declared),
        "cost_by_service_year": year + _REPORTS["cost_by_service"],
        "stored_panorama_month": month + _REPORTS["panorama"],
        **{name: every + text for name, text in _STORED.items()},
    }
    for name, text in _REPORTS.items():
        found[name] = every + text
        found[f"{name}_month"] = month + text
    return {name: _BILL + text for name, text in found.items()}
