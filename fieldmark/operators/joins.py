"""Joins: enrichment, skew handling, membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNREGISTERED, NO_TITLE = "UNREGISTERED", "<not in registry>"
JOIN_MODES = ("auto", "broadcast", "sortmerge")


def size_estimate(df: DataFrame) -> int:
    """The optimizer's estimate of df's bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hinted(df: DataFrame, mode: str = "auto", broadcast_limit: int = 256 << 20) -> DataFrame:
    """auto: Spark picks by its statistics. broadcast: only while the estimated size is under the limit. sortmerge: forced."""
    if mode not in JOIN_MODES:
        raise ValueError(f"join mode {mode!r} is none of {JOIN_MODES}")
    if mode == "broadcast" and size_estimate(df) <= broadcast_limit:
        return F.broadcast(df)
    return df.hint("merge") if mode == "sortmerge" else df


def enrich(facts: DataFrame, dim: DataFrame, mode: str = "auto", key: str = "datasetkey", columns: tuple[str, ...] = ("publisher_key", "publisher_title", "publisher_country", "license")) -> DataFrame:
    """Every fact stays; one without a dimension row belongs to UNREGISTERED."""
    joined = facts.join(hinted(dim.select(key, *columns), mode), key, "left")
    return joined.withColumns({"publisher_key": F.coalesce("publisher_key", F.lit(UNREGISTERED)), "publisher_title": F.coalesce("publisher_title", F.lit(NO_TITLE))})


def unmatched(facts: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """How many rows, and how many of them have no partner: one row."""
    found = facts.join(dim.select(key).distinct().withColumn("__hit", F.lit(1)), key, "left")
    return found.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("__hit").isNull()).alias("unmatched"))


def salted_join(big: DataFrame, small: DataFrame, key: str, salts: int = 16, spread: str | None = None, how: str = "inner") -> DataFrame:
    """Equi-join whose hot keys are dealt over salts tasks: big's rows get a salt from spread (a unique column), small is repeated.

    The salt is a function of the row, so a task that runs again deals its rows as before.
    """
    spread_col = F.col(spread) if spread else F.struct(*big.columns)
    left = big.withColumn("__salt", F.pmod(F.xxhash64(spread_col), F.lit(salts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "__salt"], how).drop("__salt")


def with_group_aggregate(df: DataFrame, key: str, *measures) -> DataFrame:
    """df joined with its own aggregate by key."""
    return df.join(df.groupBy(key).agg(*measures), key)


def pending(all_keys: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Keys that are not done yet."""
    return all_keys.join(done.select(key), key, "left_anti")


def merge_caches(*frames: DataFrame) -> DataFrame:
    """Union by name; a column that one lacks is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
