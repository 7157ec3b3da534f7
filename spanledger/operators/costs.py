"""Monthly costs by season, with the annual total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cost_projection(rows: DataFrame, month: str, variable: Column, fixed: Column) -> DataFrame:
    """Variable, fixed and total cost of each month and one row (NULL month) for the year."""
    return rows.rollup(month).agg(
        F.grouping_id().cast("int").alias("is_total"),
        F.sum(variable).alias("variable_cost"),
        F.sum(fixed).alias("fixed_cost"),
        F.sum(variable + fixed).alias("total_cost"),
    )
