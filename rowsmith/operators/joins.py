"""Join helpers that stay partitioned at any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_in(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """``column NOT IN (values)`` with SQL's NULL rules, without broadcasting the values.

    A NULL among the values lets nothing pass; without any values everything passes. Both
    facts are one row, joined to the anti join's result.
    """
    listed = values.select(F.col(values.columns[0]).alias(column))
    facts = listed.agg(
        F.count("*").alias("listed_"), F.count_if(F.col(column).isNull()).alias("nulls_")
    )
    unmatched = df.join(listed, column, "left_anti").crossJoin(facts)
    passes = (F.col("listed_") == 0) | ((F.col("nulls_") == 0) & F.col(column).isNotNull())
    return unmatched.filter(passes).select(*df.columns)
