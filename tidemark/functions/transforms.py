"""Named transforms, and chains of row transforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMED: dict[str, str] = {
    "to_str": "coalesce(CAST({0} AS STRING), '')",
    "to_int": "try_cast(try_cast({0} AS DOUBLE) AS BIGINT)",
    "to_float": "try_cast({0} AS DOUBLE)",
    "datetime_to_date": "CAST({0} AS DATE)",
    "lowercase": "lower({0})",
    "uppercase": "upper({0})",
    "strip": "trim({0})",
    "length": "length({0})",
}


def named(name: str, column: str) -> Column:
    return F.expr(NAMED[name].format(column))


def transform_chain(df: DataFrame, steps: list[tuple[str, str | Callable[[DataFrame], Column] | Column]], status: str | None = None) -> DataFrame:
    """New columns in order, each an SQL expression, a Column (of a UDF, say) or a function of the
    frame; later steps see earlier ones. With a status column, deleted rows (D) are left as they are."""
    for name, step in steps:
        value = F.expr(step) if isinstance(step, str) else step(df) if callable(step) and not isinstance(step, Column) else step
        if status:
            before = F.col(name) if name in df.columns else F.lit(None)
            value = F.when(F.col(status) == "D", before).otherwise(value)
        df = df.withColumn(name, value)
    return df
