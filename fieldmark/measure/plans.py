"""Reading physical plans."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

#: Join operators, as they stand in plans.
JOINS = ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct")


def physical_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df: DataFrame) -> str:
    """The plan that ran: of an adaptive plan only the final part. df must have been executed through this object."""
    text = physical_plan(df)
    return text.split("== Initial Plan ==")[0] if "isFinalPlan=true" in text else text


def join_strategies(df: DataFrame) -> list[str]:
    return re.findall("|".join(JOINS), final_plan(df))


def exchange_count(df: DataFrame) -> int:
    return len(re.findall(r"(?<![A-Za-z])Exchange (?:hash|range|Round|Single)", final_plan(df)))


def scan_stats(df: DataFrame) -> dict[str, list[str]]:
    """Partition filters, pushed filters and read schema of each scan."""
    text = df._jdf.queryExecution().executedPlan().toString()
    grab = lambda name, close: re.findall(rf"{name}: ?(.*?)(?:{close})", text)
    return {"partition_filters": grab("PartitionFilters", r"\], "), "pushed_filters": grab("PushedFilters", r"\], "), "read_schema": grab("ReadSchema", r"\n|$")}


def columns_scanned(df: DataFrame) -> set[str]:
    """The columns that the plan's scans give, after pruning."""
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    outputs = [leaves.apply(i).output() for i in range(leaves.size())]
    return {out.apply(k).name() for out in outputs for k in range(out.size())}


def partition_count(df: DataFrame) -> int:
    return df.rdd.getNumPartitions()


def explain_text(df: DataFrame, mode: str = "formatted") -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
