"""Incremental ingestion as a stream over files: every file is curated once, whatever fails and runs again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sinks.ingest import by_decade


def ingest_available(spark: SparkSession, source: str, schema: T.StructType, root: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], max_bytes: str | None = None, max_files: int | None = None) -> int:
    """Take all files that are there and not yet taken, in micro-batches of the given budget; the number of batches.

    A micro-batch replaces its own partition ingest_batch=s<id>, so one that runs again after a failure leaves its
    rows once.
    """
    reader = spark.readStream.schema(schema)
    for key, value in (("maxBytesPerTrigger", max_bytes), ("maxFilesPerTrigger", max_files)):
        if value is not None:
            reader = reader.option(key, str(value))
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        rows = transform(batch).withColumn("ingest_batch", F.lit(f"s{number:06d}"))
        placed = by_decade(rows) if "decade" in rows.columns else rows
        keys = [c for c in ("ingest_batch", "decade") if c in rows.columns]
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(root)
        done.append(number)

    query = reader.parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(done)
