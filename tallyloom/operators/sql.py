"""Free SQL over the bill."""

from __future__ import annotations

from pyspark.sql import DataFrame


def sql_report(bill: DataFrame, text: str, name: str = "bill") -> DataFrame:
    """Run Spark SQL over the bill, which the text calls ``{bill}``.

    The bill is a parameter of this one query: no view stays behind, and none of
    the session is replaced. ``name`` is another name to call it by. Other braces
    in the text are doubled. The result is a typed DataFrame without a row cap. To
    unnest a map, write ``LATERAL VIEW explode(resource_tags) t AS tag_key, tag_value``.
    """
    return bill.sparkSession.sql(text, **{name: bill})
