"""Ranks and running sums over orders that no single task could hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize

_INDEX_BITS = 33  # of monotonically_increasing_id(): the row's place in its partition


def _placed(df: DataFrame, order: list[str], at: str, part: str, tag: str) -> DataFrame:
    """df dealt by ranges of the order and written, with part (the row's range) and at (its place in it)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    index = F.lit((1 << _INDEX_BITS) - 1)
    return materialize(rows, tag).withColumn(part, F.shiftright(at, _INDEX_BITS)).withColumn(at, F.col(at).bitwiseAND(index))


def _before(sums: DataFrame, part: str, value: Column, start: str) -> DataFrame:
    """part, start: the sum of value over the parts before; sums has a row a partition."""
    order = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(part, F.coalesce(F.sum(value).over(order), F.lit(0)).alias(start))


def global_rank(df: DataFrame, order: list[str], rank: str, tag: str) -> DataFrame:
    """df with rank, a long from 0 without gaps, by the columns of order.

    Rows are dealt by ranges of the whole order (ties included, so a value that a third of the rows share is split
    as long as a later column tells its rows apart), numbered in their partition, written once, and shifted by the
    counts of the partitions before. Rows that tie in all columns of order are numbered in any order.
    """
    at, part, start = (fresh(df, n, rank) for n in ("at__", "part__", "start__"))
    placed = _placed(df, order, at, part, tag)
    starts = _before(placed.groupBy(part).agg(F.count(F.lit(1)).alias("n")), part, F.col("n"), start)
    ranked = placed.join(F.broadcast(starts), part)  # at most a row a partition
    return ranked.withColumn(rank, F.col(start) + F.col(at)).drop(part, start, at)


def global_sum(df: DataFrame, order: list[str], value: str, out: str, tag: str) -> DataFrame:
    """df with out: the sum of value over the rows before this one by the columns of order, which tell all rows apart."""
    at, part, start, inside = (fresh(df, n, out) for n in ("at__", "part__", "start__", "inside__"))
    placed = _placed(df, order, at, part, tag)
    starts = _before(placed.groupBy(part).agg(F.sum(value).alias("n")), part, F.col("n"), start)
    within = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn(inside, F.coalesce(F.sum(value).over(within), F.lit(0))).join(F.broadcast(starts), part)  # a row a partition
    return rows.withColumn(out, F.col(start) + F.col(inside)).drop(part, start, at, inside)


def running_sum(df: DataFrame, group: str, order: list[Column], spread: Column, value: str, out: str, n: int, rows_a_bucket: int = 200_000) -> DataFrame:
    """df (of n rows) with out: the sum of value over the group's rows before this one.

    The order within a group is: bucket of spread (a long that is dealt evenly over 0 to 2**30 - 1), then order. Each
    bucket is a window of its own, so a hot group is dealt over as many tasks as its rows need.
    """
    buckets = 1
    while n / buckets > rows_a_bucket or buckets < 64:
        buckets *= 2
    bucket, start, inside = (fresh(df, x, out) for x in ("bucket__", "start__", "inside__"))
    rows = df.withColumn(bucket, F.shiftright(spread.cast("long"), 30 - (buckets.bit_length() - 1)))
    sums = rows.groupBy(group, bucket).agg(F.sum(value).alias("sum"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    starts = sums.select(group, bucket, F.coalesce(F.sum("sum").over(before), F.lit(0)).alias(start))
    within = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(inside, F.coalesce(F.sum(value).over(within), F.lit(0)))
    return rows.join(starts, [group, bucket]).withColumn(out, F.col(start) + F.col(inside)).drop(bucket, start, inside)
