"""What a block of Spark work cost: time, bytes, files, shuffle, spill, tasks."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from contextlib import contextmanager
from statistics import median

from pyspark.sql import SparkSession

#: The factor of each unit (bytes, or milliseconds).
UNITS = {"B": 1, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30, "TiB": 1 << 40, "KB": 10**3, "MB": 10**6, "GB": 10**9, "ns": 1e-6, "ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000}
_FACTORS = {k.lower(): v for k, v in UNITS.items()}
_VALUE = re.compile(r"\(?\s*([0-9][0-9,]*\.?[0-9]*)\s*([A-Za-z]*)")


def parse_metric(text) -> float:
    """A count, a size or a time as a number; of two-line aggregates the total in the second line; junk is 0."""
    lines = str(text).split("\n")
    found = _VALUE.match(lines[1 if len(lines) > 1 else 0].strip())
    return float(found[1].replace(",", "")) * _FACTORS.get(found[2].lower(), 1) if found else 0.0


def conf_bytes(spark, key: str) -> int:
    """A byte setting, with or without a unit."""
    value = str(spark.conf.get(key)).strip().lower()
    power = {"k": 10, "m": 20, "g": 30, "t": 40}
    digits = value.removesuffix("b")
    return int(digits[:-1]) << power[digits[-1]] if digits and digits[-1] in power else int(digits)


def readable_bytes(n: float | None) -> str:
    n = n or 0
    for unit, size in (("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10)):
        if n >= size:
            return f"{n / size:.2f} {unit}"
    return f"{int(n)} B"


class Measurement(dict):
    """The metrics of a block by name."""

    def __str__(self) -> str:
        return f"{self['label']}: {self['seconds']:.1f} s, {readable_bytes(self['read_bytes'])} read, {int(self['files'])} files, {readable_bytes(self['shuffle_bytes'])} shuffle, {readable_bytes(self['spill_bytes'])} spill, {int(self['tasks'])} tasks"


class Rest:
    """The application's REST endpoint. Without a UI everything is empty."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = spark.sparkContext.uiWebUrl

    def json(self, path: str):
        if not self.base:
            return []
        with urllib.request.urlopen(f"{self.base}/api/v1/applications/{self.spark.sparkContext.applicationId}/{path}", timeout=10) as answer:
            return json.load(answer)

    def executions(self, after: int = -1) -> list[dict]:
        return [e for e in self.json("sql?details=true&length=100000") if int(e["id"]) > after]

    def stages(self, after: int = -1) -> list[dict]:
        return [s for s in self.json("stages") if int(s["stageId"]) > after and s["status"] == "COMPLETE"]

    #: The shares of a stage's tasks at which quantiles are told.
    QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)

    def quantiles(self, stage: int, attempt: int = 0) -> dict[str, list[float]]:
        """Duration and run time in ms, bytes read, shuffled and spilled of a stage's tasks at QUANTILES; empty if unknown."""
        try:
            told = self.json(f"stages/{stage}/{attempt}/taskSummary?quantiles={','.join(map(str, self.QUANTILES))}")
        except urllib.error.HTTPError:  # a stage that has no finished task has no summary
            return {}
        if not told:
            return {}
        inside = {"read_bytes": ("inputMetrics", "bytesRead"), "shuffle_read_bytes": ("shuffleReadMetrics", "readBytes"), "shuffle_bytes": ("shuffleWriteMetrics", "writeBytes")}
        plain = {"duration_ms": "duration", "run_ms": "executorRunTime", "gc_ms": "jvmGcTime", "spill_bytes": "diskBytesSpilled"}
        return {k: told[v] for k, v in plain.items()} | {k: told[a][b] for k, (a, b) in inside.items()}

    def task_spread(self, stage: int, attempt: int = 0) -> dict:
        """Median and longest task of a stage in ms, and their ratio."""
        times = [t["duration"] for t in self.json(f"stages/{stage}/{attempt}/taskList?length=100000") if "duration" in t]
        mid, most = (median(times), max(times)) if times else (0, 0)
        return {"stage": stage, "tasks": len(times), "median_ms": mid, "longest_ms": most, "ratio": most / max(mid, 1)}

    def storage(self) -> list[dict]:
        return [{"name": r["name"], "cached": r["numCachedPartitions"] / max(1, r["numPartitions"]), "memory": r["memoryUsed"], "disk": r["diskUsed"]} for r in self.json("storage/rdd")]

    def exchanges(self, after: int = -1) -> list[dict]:
        """Exchange operators with their partitions and bytes, which are fields of their own."""
        out = []
        for e in self.executions(after):
            for node in e.get("nodes", []):
                if "Exchange" in node["nodeName"]:
                    m = {x["name"]: x["value"] for x in node.get("metrics", [])}
                    out.append({"execution": int(e["id"]), "operator": node["nodeName"], "partitions": parse_metric(m.get("number of partitions", 0)), "bytes": parse_metric(m.get("data size", 0)), "written": parse_metric(m.get("shuffle bytes written", 0))})
        return out

    def settle(self, after: int, grace: float = 1.0, timeout: float = 20.0) -> list[dict]:
        """Executions after a mark, once none runs and their metrics stay as they are; a block without any waits for the grace alone."""
        if not self.base:
            return []
        began, last = time.time(), None
        while time.time() - began < timeout:
            found = self.executions(after)
            now = [(e["id"], sum(len(n.get("metrics", [])) for n in e.get("nodes", []))) for e in found]
            if not found and time.time() - began > grace:
                return []
            if found and now == last and all(e["status"] != "RUNNING" for e in found):
                return found
            last = now
            time.sleep(0.2)
        return self.executions(after)


#: The SQL metrics that are summed, by the names that Spark gives them.
SQL_METRICS = {
    "files": ("number of files read",),
    "partitions": ("number of partitions read",),
    "read_bytes": ("size of files read",),
    "scan_ms": ("scan time",),
    "shuffle_bytes": ("shuffle bytes written",),
    "shuffle_read_bytes": ("local bytes read", "remote bytes read"),
    "spill_bytes": ("spill size",),
    "peak_memory_bytes": ("peak memory",),
    "scan_rows": ("number of output rows",),
}


@contextmanager
def measure(spark: SparkSession, label: str):
    """Yields a Measurement that is filled when the block ends; work is attributed by execution ids above a mark."""
    rest = Rest(spark)
    mark = max([int(e["id"]) for e in rest.executions()], default=-1)
    stage_mark = max([int(s["stageId"]) for s in rest.json("stages")], default=-1)
    m = Measurement(label=label, seconds=0.0, executions=[], tasks=0, cpu_s=0.0, gc_s=0.0, stages=0, rows=0, failed=False, **{k: 0.0 for k in SQL_METRICS})
    began = time.time()
    try:
        yield m
    except BaseException:
        m["failed"] = True
        raise
    finally:
        m["seconds"] = time.time() - began
        found = rest.settle(mark)
        m["executions"] = [int(e["id"]) for e in found]
        for e in found:
            for node in e.get("nodes", []):
                scan = "Scan" in node["nodeName"]
                for metric in node.get("metrics", []):
                    for key, names in SQL_METRICS.items():
                        if metric["name"] in names and (key != "scan_rows" or scan):
                            m[key] += parse_metric(metric["value"])
        for s in rest.stages(stage_mark):
            m["stages"] += 1
            m["tasks"] += s["numCompleteTasks"]
            m["cpu_s"] += s["executorCpuTime"] / 1e9
            m["gc_s"] += s.get("jvmGcTime", 0) / 1e3


def totals(rows: list[dict]) -> dict:
    """Sums of the numeric metrics over stages."""
    keys = [k for k, v in (rows[0].items() if rows else ()) if isinstance(v, (int, float)) and not isinstance(v, bool)]
    return {k: sum(r[k] for r in rows) for k in keys}


def bottleneck(m: dict, wall: float, hot_share: float = 0.15) -> tuple[str, bool]:
    """What bounds a stage (read, if it reads over ten times what it shuffles), and whether it is a hot one."""
    return ("read" if m["read_bytes"] > 10 * m["shuffle_bytes"] else "shuffle"), m["seconds"] >= hot_share * wall


def break_even(build_s: float, saved_s: float) -> float:
    """Readers from which a cache pays off; infinite if a read saves nothing."""
    return build_s / saved_s + 1 if saved_s > 0 else float("inf")


def table_text(rows: list[dict], columns: list[str] | None = None) -> str:
    columns = columns or list(rows[0]) if rows else []
    cells = [[str(r.get(c, "")) for c in columns] for r in rows]
    widths = [max([len(c), *(len(x[i]) for x in cells)]) for i, c in enumerate(columns)]
    return "\n".join("  ".join(v.rjust(w) for v, w in zip(line, widths)) for line in [columns, *cells])
