"""The one path all cost reports take: filter, group, sum, show, sort."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.amounts import Measure, cost
from tallyloom.sources.bill import Period, for_period

Dims = Mapping[str, Column]
Measures = Mapping[str, Measure]


def grouped_totals(
    bill: DataFrame,
    dims: Dims,
    measures: Measures,
    period: Period = None,
    where: Sequence[Column] = (),
) -> DataFrame:
    """Exact, unsorted totals per group, for use by further operators.

    Costs stay decimal(38,12), so totals of totals lose nothing. Every measure
    is summed within each task before the shuffle, so a group that holds a large
    part of the bill reaches its reducer as one row per task.
    """
    rows = for_period(bill, period)
    for condition in where:
        rows = rows.where(condition)
    keys = [value.alias(name) for name, value in dims.items()]
    totals = [measure.total.alias(name) for name, measure in measures.items()]
    return rows.groupBy(*keys).agg(*totals)


def shown(totals: DataFrame, measures: Measures) -> DataFrame:
    """Replace the exact totals by their reported form."""
    return totals.withColumns(
        {name: measure.shown(F.col(name)) for name, measure in measures.items()}
    )


def by_cost(dims: Iterable[str], first: str | None = "cost_usd") -> list[Column]:
    """Highest cost first, ties in the order of the dimensions, NULLs last."""
    highest = [] if first is None else [F.desc_nulls_last(first)]
    return [*highest, *map(F.asc_nulls_last, dims)]


def cost_report(
    bill: DataFrame,
    dims: Dims,
    measures: Measures | None = None,
    period: Period = None,
    where: Sequence[Column] = (),
    order: Sequence[Column] | None = None,
    sort: bool = True,
) -> DataFrame:
    """A finished report: dimensions, measures, highest cost first.

    The sort costs a second shuffle, of the grouped rows. Pass ``sort=False``
    where the order does not matter. Without ``order``, a report with measures of
    its own is sorted by the first of them, highest first, if it has no cost.
    """
    if measures is None:
        measures = {"cost_usd": cost()}
    report = shown(grouped_totals(bill, dims, measures, period, where), measures)
    if not sort:
        return report
    if order is None:
        order = by_cost(dims, "cost_usd" if "cost_usd" in measures else next(iter(measures), None))
    return report.orderBy(*order) if order else report
