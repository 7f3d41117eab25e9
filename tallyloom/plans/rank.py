"""Rankings and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.amounts import Measure, as_usd, cost, share_of
from tallyloom.functions.columns import filled
from tallyloom.operators.cost_report import by_cost, grouped_totals, shown
from tallyloom.plans.reports import cost_by_resource
from tallyloom.sources.bill import Period

# A power of two. Masking a hash is never NULL as far as Spark can tell, so the
# join adds no NULL filter on one side, and both sides share one reading of the bill.
SALTS = 256


def top_resources(bill: DataFrame, n: int = 20, period: Period = None) -> DataFrame:
    """The ``n`` most expensive resources with their rank.

    Each task keeps its own best ``n``, so what meets in the last task, and is
    numbered there, is bounded by ``n`` and not by the bill.
    """
    best = cost_by_resource(bill, period).limit(n)
    order = by_cost(["resource_id", "service", "region"])
    rank = F.row_number().over(Window.orderBy(*order)).cast("long")
    return best.select(rank.alias("rank"), "*").orderBy("rank")


def shared_resources(
    bill: DataFrame, period: Period = None, sort: bool = True
) -> DataFrame:
    """Resources with more than one principal, and each principal's share.

    The bill is first reduced to one row per resource and principal. These could
    still be very many for one resource, so they are never brought together:
    each is counted under its resource and one of ``SALTS`` hash values of its
    principal, the at most ``SALTS`` counts of a resource are added up, and the
    rows then meet their resource's total in a join on both keys.
    """
    measures = {"cost_usd": cost()}
    resource, principal = F.col("line_item_resource_id"), F.col("line_item_iam_principal")
    pairs = grouped_totals(
        bill,
        {"resource_id": resource, "iam_principal": principal},
        measures,
        period,
        where=[filled(resource), filled(principal)],
    ).withColumn("salt", F.xxhash64("iam_principal").bitwiseAND(SALTS - 1))
    whole = Window.partitionBy("resource_id")
    per_salt = (
        pairs.groupBy("resource_id", "salt")
        .agg(F.sum("cost_usd").alias("salt_cost"), F.count("*").alias("salt_principals"))
        .select(
            "resource_id",
            "salt",
            F.sum("salt_cost").over(whole).alias("resource_cost_usd"),
            F.sum("salt_principals").over(whole).alias("principals"),
        )
        .where(F.col("principals") > 1)
    )
    measures["resource_cost_usd"] = Measure(F.sum("resource_cost_usd"), as_usd)
    report = shown(pairs.join(per_salt, ["resource_id", "salt"]), measures).select(
        "resource_id",
        "iam_principal",
        "cost_usd",
        "resource_cost_usd",
        "principals",
        share_of(F.col("cost_usd"), F.col("resource_cost_usd")).alias("cost_share"),
    )
    if not sort:
        return report
    return report.orderBy(*by_cost(["resource_id", "iam_principal"]))
