"""Experiments: the same work under different settings, measured; and whole job runs in fresh processes, compared.

Each experiment returns rows (dicts) that table_text() prints and write_report() keeps.
"""

from __future__ import annotations

import json
import os
import signal
import subprocess
import sys
import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..measure import plans as P
from ..measure.metrics import Rest, bottleneck, break_even, measure
from ..operators import aggregates, joins, windows
from ..sinks.ingest import LAYOUTS, write_layout
from ..sources import storage
from ..sources.tables import file_sizes, read_table, size_histogram
from . import job


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """Session settings for a block; what was set before comes back."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def force(df: DataFrame) -> None:
    """Compute every row and keep none."""
    df.write.format("noop").mode("overwrite").save()


def compare(spark: SparkSession, variants: dict[str, tuple[dict[str, str], Callable[[], DataFrame]]]) -> list[dict]:
    """A row a variant: time, bytes, tasks, and the plan's joins and exchanges."""
    rows = []
    for name, (conf, build) in variants.items():
        with settings(spark, conf):
            df = build()
            with measure(spark, name) as m:
                force(df)
            rows.append({"variant": name, "seconds": round(m["seconds"], 2), "read": m["read_bytes"], "shuffle": m["shuffle_bytes"], "spill": m["spill_bytes"], "tasks": m["tasks"], "joins": "+".join(P.join_strategies(df)), "exchanges": P.exchange_count(df)})
    return rows


def input_packing(spark: SparkSession, cfg: job.Config) -> list[dict]:
    """Split sizes of 32, 128 and 512 MB."""
    build = lambda: read_table(spark, cfg.table, cfg.batches).groupBy("country").count()
    return compare(spark, {f"{mb} MB": ({"spark.sql.files.maxPartitionBytes": str(mb << 20)}, build) for mb in (32, 128, 512)})


def pruning(spark: SparkSession, cfg: job.Config) -> list[dict]:
    """All columns, two columns, filters on one and two partition columns, a row group filter."""
    table = read_table(spark, cfg.table, cfg.batches)
    variants = {
        "all columns": lambda: aggregates.checksum(table),
        "two columns": lambda: aggregates.checksum(table, ["gbifid", "country"]),
        "partition filter": lambda: aggregates.checksum(table.where("decade >= 2000")),
        "two partition filters": lambda: aggregates.checksum(table.where("ingest_batch = 'b0000' and decade = 2000")),
        "row group filter": lambda: aggregates.checksum(table.where("country = 'SE'"), ["gbifid"]),
    }
    return compare(spark, {k: ({}, v) for k, v in variants.items()})


def shuffle_partitions(spark: SparkSession, cfg: job.Config) -> list[dict]:
    build = lambda: read_table(spark, cfg.table, cfg.batches).groupBy("datasetkey", "decade").count()
    return compare(spark, {f"{n}, aqe {aqe}": ({"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.enabled": aqe}, build) for n in (4, 12, 24, 48, 200, 800) for aqe in ("true", "false")})


def layouts(spark: SparkSession, cfg: job.Config) -> list[dict]:
    """Files, bytes and read time of each way to write the table."""
    rows, facts = [], read_table(spark, cfg.table, cfg.batches)
    for layout in LAYOUTS:
        path = f"{cfg.out}/layouts/{layout}"
        with measure(spark, layout) as wrote:
            write_layout(facts, path, layout)
        with measure(spark, layout) as read:
            force(spark.read.parquet(path).where("decade >= 2000").groupBy("decade").count())
        sizes = file_sizes(path)
        rows.append({"layout": layout, "files": len(sizes), "bytes": sum(sizes), "under 1 MB": size_histogram(sizes)[0]["files"], "write_s": round(wrote["seconds"], 2), "read_s": round(read["seconds"], 2)})
    return rows


def join_strategies(spark: SparkSession, cfg: job.Config) -> list[dict]:
    """The enrich join as Spark picks it, broadcast and sort-merge, and the size that the optimizer goes by."""
    facts, dim = read_table(spark, cfg.table, cfg.batches).select("gbifid", "datasetkey"), spark.read.parquet(cfg.dim)
    rows = compare(spark, {mode: ({"spark.sql.autoBroadcastJoinThreshold": "-1"} if mode == "sortmerge" else {}, lambda mode=mode: joins.enrich(facts, dim, mode)) for mode in joins.JOIN_MODES})
    return [r | {"dimension": joins.size_estimate(dim)} for r in rows]


def skew(spark: SparkSession, cfg: job.Config) -> list[dict]:
    """A join with the own aggregate: plain, with AQE's split, salted; the windows' trap: one partition for all."""
    facts = read_table(spark, cfg.table, cfg.batches).select("gbifid", "datasetkey", "n_issues")
    one = facts.groupBy("datasetkey").agg(F.avg("n_issues").alias("mean"))
    off, sortmerge = {"spark.sql.adaptive.skewJoin.enabled": "false"}, {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    variants = {
        "plain": (off | sortmerge, lambda: facts.join(one, "datasetkey")),
        "aqe split": (sortmerge | {"spark.sql.adaptive.skewJoin.enabled": "true"}, lambda: facts.join(one, "datasetkey")),
        "salted": (off | sortmerge, lambda: joins.salted_join(facts, one, "datasetkey", spread="gbifid")),
        "window, one partition": ({}, lambda: windows.global_rows(one, ["datasetkey"])),
    }
    return compare(spark, variants)


def caching(spark: SparkSession, cfg: job.Config) -> list[dict]:
    """Build and read times of each storage level, and from how many readers on it pays off."""
    rows, plain = [], None
    for name, level in job.CACHE_LEVELS.items():
        e = job.enriched(spark, cfg)
        build_s = 0.0
        if level:
            e = e.persist(level)
            with measure(spark, name) as m:
                e.count()
            build_s = m["seconds"]
        with measure(spark, name) as m:
            force(aggregates.breakdown(e, "decade"))
        plain = m["seconds"] if plain is None else plain
        held = Rest(spark).storage()
        rows.append({"level": name, "build_s": round(build_s, 2), "read_s": round(m["seconds"], 2), "pays_from": round(break_even(build_s, plain - m["seconds"]), 1), "cached": held[0]["cached"] if held else None})
        e.unpersist()
    return rows


def profile(spark: SparkSession, cfg: job.Config) -> list[dict]:
    """The job's stages with what bounds them, their share of the time, and the skew of their tasks."""
    summary = job.run(spark, cfg, quiet=True)
    wall = summary["wall"]
    return [{"stage": m["label"], "seconds": round(m["seconds"], 2), "share": round(m["seconds"] / wall, 3), "bound": bottleneck(m, wall)[0], "hot": bottleneck(m, wall)[1], "spill": m["spill_bytes"]} for m in summary["stages"]]


EXPERIMENTS = {f.__name__: f for f in (input_packing, pruning, shuffle_partitions, layouts, join_strategies, skew, caching, profile)}


def write_report(path: str, name: str, rows: list[dict]) -> None:
    storage.write_text(f"{path}/{name}.json", json.dumps({"experiment": name, "rows": rows}, indent=1, default=str))


# --- Before and after ------------------------------------------------------------------------------------------------

#: How a failed run is told, by what its error output holds.
FAILURES = {"out of memory": ("OutOfMemoryError", "unable to acquire"), "no space": ("No space left",), "missing input": ("missing:", "PATH_NOT_FOUND"), "no java": ("JAVA_GATEWAY_EXITED", "JAVA_HOME")}


def classify_failure(text: str) -> str:
    return next((kind for kind, marks in FAILURES.items() if any(m in text for m in marks)), "failed")


def run_fresh(arguments: list[str], timeout: float, env: dict[str, str] | None = None) -> dict:
    """A command of this library in a process group of its own, and so in a JVM of its own; the whole group ends with it."""
    began = time.time()
    child = subprocess.Popen([sys.executable, "-m", "fieldmark", *arguments], stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, start_new_session=True, env=os.environ | (env or {}))
    try:
        out, err = child.communicate(timeout=timeout)
        outcome = "ok" if child.returncode == 0 else classify_failure(err + out)
    except subprocess.TimeoutExpired:
        outcome, out = "timed out", ""
    finally:
        try:
            os.killpg(child.pid, signal.SIGKILL)
        except ProcessLookupError:
            pass
        child.wait()
    return {"outcome": outcome, "seconds": round(time.time() - began, 1), "output": out}


def before_after(variants: dict[str, list[str]], timeout: float = 1800) -> list[dict]:
    """The job under each variant's options: outcome and time, a row a variant."""
    return [{"variant": name} | run_fresh(["job", "--tag", name, *options], timeout) for name, options in variants.items()]
