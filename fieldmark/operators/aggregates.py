"""Aggregations: all map-side combined, one shuffle of partial rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import share

#: Relative error of the approximate distinct counts.
RSD = 0.02


def records() -> Column:
    return F.count(F.lit(1)).alias("records")


def standard_measures() -> list[Column]:
    return [records(), share("usable_for_mapping").alias("usable"), F.avg("n_issues").alias("mean_flags")]


def headline(e: DataFrame, approximate: bool = True) -> DataFrame:
    """Nine measures of the whole table, in one pass; distinct counts are sketches unless exact ones are asked for."""
    distinct = (lambda c: F.approx_count_distinct(c, RSD)) if approximate else F.countDistinct
    return e.agg(
        *standard_measures(),
        share(F.col("usable_for_mapping") & F.col("uncertainty_known")).alias("usable_strict"),
        share(F.col("n_issues") > 0).alias("any_flag"),
        share(F.col("n_geo_issues") > 0).alias("geo_flag"),
        distinct("specieskey").alias("species"),
        distinct("cell_id").alias("cells"),
        distinct("publisher_key").alias("publishers"),
    )


def breakdown(e: DataFrame, *keys: str) -> DataFrame:
    return e.groupBy(*keys).agg(*standard_measures())


def breakdowns(e: DataFrame, sets: dict[str, list[str]], hold: Callable[[DataFrame], DataFrame] = lambda wide: wide) -> dict[str, DataFrame]:
    """Several breakdowns from one scan and one shuffle: grouping sets, told apart by grouping_id (real nulls stay apart).

    All of them filter one aggregate. Whoever writes them one by one passes a hold that persists it (a row a group),
    or the scan is done again for each.
    """
    keys = list(dict.fromkeys(k for s in sets.values() for k in s))
    wide = hold(e.groupingSets([[F.col(k) for k in s] for s in sets.values()], *keys).agg(F.grouping_id().alias("__set"), *standard_measures()))
    bit = {k: 1 << (len(keys) - 1 - i) for i, k in enumerate(keys)}
    full = sum(bit.values())
    return {name: wide.where(F.col("__set") == full - sum(bit[k] for k in s)).select(*s, "records", "usable", "mean_flags") for name, s in sets.items()}


def by_publisher(e: DataFrame, approximate: bool = True) -> DataFrame:
    datasets = F.approx_count_distinct("datasetkey", RSD) if approximate else F.countDistinct("datasetkey")
    return e.groupBy("publisher_key", "publisher_title", "publisher_country").agg(*standard_measures(), datasets.alias("datasets"))


def by_dataset(e: DataFrame, least: int) -> DataFrame:
    """Datasets of at least so many records, with their place among their publisher's."""
    one = e.groupBy("publisher_key", "publisher_title", "datasetkey").agg(*standard_measures()).where(F.col("records") >= least)
    return rank_in_group(one, "publisher_key", "datasetkey")


def rank_in_group(df: DataFrame, group: str, tie: str) -> DataFrame:
    """Group sums and means, the row's rank by records (ties by the key) and its gap to the group's mean: one exchange."""
    whole = Window.partitionBy(group)
    ranked = whole.orderBy(F.desc("records"), tie)
    return df.withColumns(
        {
            "pub_records": F.sum("records").over(whole),
            "pub_mean_flags": F.avg("mean_flags").over(whole),
            "pub_datasets": F.count(F.lit(1)).over(whole),
            "rank_in_pub": F.row_number().over(ranked),
            "flag_gap": F.col("mean_flags") - F.avg("mean_flags").over(whole),
        }
    )


def variance_decomposition(df: DataFrame, group: str, value: str, least: int = 3) -> DataFrame:
    """Within and between variance of value over groups of at least so many rows, and between's share: one row.

    The only shuffle is of a row a group. Between is the mean square of the groups' distances from the grand mean, so
    it keeps its digits however far the values are from zero.
    """
    groups = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).where(F.col("n") >= least)
    grand = groups.agg(F.sum("n").alias("datasets"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand_mean"))
    away = F.col("m") - F.col("grand_mean")
    known = lambda c: F.coalesce(c, F.lit(0.0))
    parts = groups.join(F.broadcast(grand)).agg(  # one row
        known(F.sum(F.col("n") * away * away) / F.sum("n")).alias("between"),
        F.coalesce(F.max("datasets"), F.lit(0)).cast("long").alias("datasets"),
        known(F.max("grand_mean")).alias("grand_mean"),
        known(F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("within"),
    )
    return parts.withColumn("between_share", F.col("between") / F.greatest(F.col("between") + F.col("within"), F.lit(1e-12)))


def null_profile(df: DataFrame) -> DataFrame:
    """A row a column: non-null count and null share; one pass."""
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(c)).alias(c) for c in df.columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    long = wide.selectExpr("__rows", f"stack({len(df.columns)}, {pairs}) as (column_name, non_null)")
    return long.select("column_name", "non_null", (1 - F.try_divide("non_null", "__rows")).alias("null_share"))


def cardinality_profile(df: DataFrame, approximate: bool = True, rsd: float = 0.05) -> DataFrame:
    """A row a column: distinct values and distinct per row."""
    distinct = (lambda c: F.approx_count_distinct(c, rsd)) if approximate else F.countDistinct
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *[distinct(c).alias(c) for c in df.columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return wide.selectExpr("__rows", f"stack({len(df.columns)}, {pairs}) as (column_name, n_distinct)").select("column_name", "n_distinct", F.try_divide("n_distinct", "__rows").alias("per_row"))


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values; ties in order of the value."""
    return df.groupBy(column).agg(records()).orderBy(F.desc("records"), F.col(column).asc_nulls_last()).limit(k)


def skew_report(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k largest keys with their share of all rows, times the mean, and the share of all k: one row a key."""
    counts = df.groupBy(key).agg(records())
    totals = counts.agg(F.sum("records").alias("all_records"), F.count(F.lit(1)).alias("keys"))
    top = counts.orderBy(F.desc("records"), key).limit(k).crossJoin(F.broadcast(totals))  # one row
    return top.select(
        key,
        "records",
        (F.col("records") / F.col("all_records")).alias("share"),
        (F.col("records") * F.col("keys") / F.col("all_records")).alias("times_mean"),
        (F.sum("records").over(Window.partitionBy()) / F.col("all_records")).alias("top_share"),  # k rows
    )


def hash_placement(df: DataFrame, key: str, n: int) -> DataFrame:
    """Where a hash exchange into n partitions puts the rows: rows, keys and the largest key of each."""
    counts = df.groupBy(key).agg(records())
    return counts.groupBy(F.pmod(F.hash(key), F.lit(n)).alias("partition")).agg(F.sum("records").alias("rows"), F.count(F.lit(1)).alias("keys"), F.max_by(key, F.struct("records", key)).alias("largest"))


def rows_per_partition(df: DataFrame) -> DataFrame:
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("rows"))


def checksum(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Forces every value to be decoded: the largest row hash."""
    return df.agg(F.max(F.xxhash64(*(columns or df.columns))).alias("checksum"))
