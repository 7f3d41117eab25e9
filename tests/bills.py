"""Small bills written out line by line."""

from pyspark.sql import types as T

BILL = T.StructType(
    [
        T.StructField("billing_period", T.StringType()),
        T.StructField("line_item_usage_start_date", T.TimestampType()),
        T.StructField("line_item_resource_id", T.StringType()),
        T.StructField("line_item_iam_principal", T.StringType()),
        T.StructField("line_item_product_code", T.StringType()),
        T.StructField("line_item_line_item_type", T.StringType()),
        T.StructField("line_item_usage_type", T.StringType()),
        T.StructField("line_item_operation", T.StringType()),
        T.StructField("product_region_code", T.StringType()),
        T.StructField("line_item_usage_amount", T.DoubleType()),
        T.StructField("line_item_unblended_cost", T.DoubleType()),
        T.StructField("reservation_effective_cost", T.DoubleType()),
        T.StructField("savings_plan_savings_plan_effective_cost", T.DoubleType()),
        T.StructField("resource_tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    ]
)
SHORT = {
    "resource": "line_item_resource_id",
    "principal": "line_item_iam_principal",
    "service": "line_item_product_code",
    "type": "line_item_line_item_type",
    "region": "product_region_code",
    "cost": "line_item_unblended_cost",
    "usage": "line_item_usage_amount",
    "start": "line_item_usage_start_date",
    "period": "billing_period",
    "ri_cost": "reservation_effective_cost",
    "sp_cost": "savings_plan_savings_plan_effective_cost",
}
DEFAULTS = {
    "billing_period": "2026-06",
    "line_item_product_code": "svc",
    "line_item_line_item_type": "Usage",
    "line_item_usage_amount": 1.0,
    "line_item_unblended_cost": 1.0,
    "reservation_effective_cost": 0.0,
    "savings_plan_savings_plan_effective_cost": 0.0,
}


def bill(spark, *lines):
    rows = []
    for line in lines:
        named = {SHORT.get(key, key): value for key, value in line.items()}
        values = {**DEFAULTS, **named}
        rows.append(tuple(values.get(field.name) for field in BILL))
    return spark.createDataFrame(rows, BILL)


def rows(frame):
    return [tuple(row) for row in frame.collect()]
