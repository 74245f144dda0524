"""The session builder."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that hold for every session; callers may override each.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    app: str = "fieldmark",
    cores: int | str | None = None,
    memory: str | None = None,
    max_failures: int = 1,
    ui: bool = False,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A local session unless SPARK_MASTER names a cluster; SPARK_CORES and SPARK_MEM override the arguments' defaults."""
    cores = cores or os.environ.get("SPARK_CORES", "*")
    memory = memory or os.environ.get("SPARK_MEM", "6g")
    conf = DEFAULTS | {"spark.ui.enabled": str(ui).lower(), "spark.driver.memory": memory} | (extra or {})
    builder = SparkSession.builder.appName(app).master(os.environ.get("SPARK_MASTER", f"local[{cores},{max_failures}]"))
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
