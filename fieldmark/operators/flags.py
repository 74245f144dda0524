"""Row-multiplying operators over flag arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, *keys: str, flags: str = "issues") -> DataFrame:
    """A row for each flag of each row; rows without flags give none. Only keys and flag are carried through."""
    return df.select(*keys, F.explode(flags).alias("flag"))


def flag_counts(df: DataFrame, *keys: str, flags: str = "issues") -> DataFrame:
    return exploded(df, *keys, flags=flags).groupBy(*keys, "flag").agg(F.count(F.lit(1)).alias("records"))


def explosion(df: DataFrame, count: str = "n_issues") -> DataFrame:
    """Rows before and after an explode, from the counts alone."""
    return df.agg(F.count(F.lit(1)).alias("rows_before"), F.coalesce(F.sum(count), F.lit(0)).alias("rows_after"), F.avg(count).alias("factor"))


def struct_field(df: DataFrame, array: str, field: str) -> DataFrame:
    """Counts of a field of an array of structs."""
    return df.select(F.explode(array).alias("i")).groupBy(F.col(f"i.{field}").alias(field)).agg(F.count(F.lit(1)).alias("records"))


def replicated(df: DataFrame, n: int, column: str = "copy") -> DataFrame:
    return df.withColumn(column, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
