"""Windows over small aggregates: aggregate first, then window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trend(df: DataFrame, group: str, order: str, value: str, width: int = 5) -> DataFrame:
    """Value of the row before, change in per cent, rolling mean, running total and first value, in one exchange."""
    w = Window.partitionBy(group).orderBy(order)
    rolling = w.rowsBetween(-(width - 1), Window.currentRow)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    previous = F.lag(value).over(w)
    return df.withColumns(
        {
            "previous": previous,
            "change_pct": F.round(F.try_divide((F.col(value) - previous) * 100.0, previous), 1),
            "rolling_mean": F.avg(value).over(rolling),
            "running_total": F.sum(value).over(upto),
            "first_value": F.first(value).over(upto),
        }
    )


def top_n(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first n rows of each group; order must be total."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def global_rows(df: DataFrame, order: list) -> DataFrame:
    """row_number over the whole table: one task, so for aggregates of bounded size only."""
    return df.withColumn("row", F.row_number().over(Window.orderBy(*order)))
