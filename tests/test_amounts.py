"""Exact sums: equal to decimal arithmetic, whatever the amounts and their order."""

from decimal import ROUND_HALF_UP, Context, Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions.amounts import as_double, as_usd, exact_sum, share_of

WIDE = Context(prec=60)


def decimal_sum(amounts):
    total = Decimal(0)
    for amount in amounts:
        line = Decimal(repr(amount)).quantize(
            Decimal("1e-12"), rounding=ROUND_HALF_UP, context=WIDE
        )
        total = WIDE.add(total, line)
    return total


def spark_sum(spark, amounts, parts=3):
    frame = spark.createDataFrame([(a,) for a in amounts], "a double").repartition(parts)
    return frame.agg(exact_sum(F.col("a")).alias("s")).first().s


cents = st.integers(-(10**9), 10**9).map(lambda n: n / 100)
fine = st.integers(-(10**14), 10**14).map(lambda n: n / 10**12)
micro = st.integers(-(10**13), 10**13).map(lambda n: n / 10**6)
any_size = st.floats(-1e12, 1e12, allow_nan=False)
tiny = st.floats(-1e-5, 1e-5, allow_nan=False)


@settings(
    max_examples=40, deadline=None, suppress_health_check=[HealthCheck.too_slow]
)
@given(
    amounts=st.lists(st.one_of(cents, fine, micro, any_size, tiny), min_size=1, max_size=60)
)
def test_equals_decimal_sum(spark, amounts):
    assert spark_sum(spark, amounts) == decimal_sum(amounts)


def test_matches_plain_decimal_cast_on_a_table(spark):
    frame = spark.range(20000).select(
        F.col("id"),
        F.when(F.col("id") % 4 == 0, F.round(F.rand(1) * 1e5, 2))
        .when(F.col("id") % 4 == 1, F.round(F.rand(2) * 10, 10))
        .when(F.col("id") % 4 == 2, -F.rand(3) * 1e7)
        .otherwise(F.rand(4) / 1e6)
        .alias("a"),
    )
    result = frame.groupBy(F.col("id") % 7).agg(
        exact_sum(F.col("a")).alias("exact"),
        F.sum(F.col("a").cast("decimal(28,12)")).alias("plain"),
    )
    assert result.schema["exact"].dataType == result.schema["plain"].dataType
    assert all(row.exact == row.plain for row in result.collect())


def test_many_tiny_charges_do_not_vanish(spark):
    frame = spark.range(100000).select(F.lit(3.5e-8).alias("a"))
    assert frame.agg(as_usd(exact_sum(F.col("a"))).alias("s")).first().s == 0.0035


def test_large_totals(spark):
    frame = spark.range(1000).select(F.lit(999999.99).alias("a"))
    assert frame.agg(exact_sum(F.col("a")).alias("s")).first().s == Decimal("999999990.00")
    assert spark_sum(spark, [1e15, 1e15, 0.1, -3.0]) == Decimal("1999999999999997.1")


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_order_and_parallelism_do_not_matter(spark, parts):
    amounts = [0.1, 1e9, -1e9, 0.2, 123456.78, -0.3, 1 / 3] * 5
    assert spark_sum(spark, amounts, parts) == decimal_sum(amounts)


def test_nulls(spark):
    frame = spark.createDataFrame([(None,), (2.5,), (None,)], "a double")
    assert frame.agg(exact_sum(F.col("a")).alias("s")).first().s == Decimal("2.5")
    assert frame.where("a IS NULL").agg(exact_sum(F.col("a")).alias("s")).first().s is None
    assert frame.where("a > 9").agg(exact_sum(F.col("a")).alias("s")).first().s is None


def test_shown_forms(spark):
    row = spark.range(1).select(
        as_usd(F.lit(Decimal("1.0000005"))).alias("usd"),
        as_double(F.lit(Decimal("1.0000000005"))).alias("number"),
        share_of(F.lit(1.0), F.lit(0.0)).alias("none"),
        share_of(F.lit(1.0), F.lit(4.0)).alias("quarter"),
    ).first()
    assert tuple(row) == (1.000001, 1.0000000005, None, 0.25)
