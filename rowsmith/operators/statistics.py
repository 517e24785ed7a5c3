"""Column statistics of any DataFrame, in one pass of partial aggregates.

Catalog tables have ``ANALYZE TABLE ... FOR ALL COLUMNS``; this is for the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_statistics(df: DataFrame) -> DataFrame:
    """``column_name, row_count, null_count, distinct_estimate, min_value, max_value``."""
    aggregates = [F.count("*").alias("rows_")]
    for i, name in enumerate(df.columns):
        value = F.col(f"`{name}`")
        aggregates += [
            F.count(value).alias(f"count{i}"),
            F.approx_count_distinct(value).alias(f"distinct{i}"),
            F.min(value).cast("string").alias(f"min{i}"),
            F.max(value).cast("string").alias(f"max{i}"),
        ]
    rows = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.col("rows_").alias("row_count"),
            (F.col("rows_") - F.col(f"count{i}")).alias("null_count"),
            F.col(f"distinct{i}").alias("distinct_estimate"),
            F.col(f"min{i}").alias("min_value"),
            F.col(f"max{i}").alias("max_value"),
        )
        for i, name in enumerate(df.columns)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))
