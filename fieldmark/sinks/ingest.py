"""Incremental ingestion: batches appended to a partitioned table, recorded in a manifest that is written last.

Table, manifest and staging folders may lie in any store that Spark reads. Whole folders are moved, so the store should
rename a folder in one step, as HDFS and local disks do. A batch is written to a staging folder and moved into the table
before the manifest names it. Compaction writes the new table beside the old one, says so in the manifest, and then
exchanges the two. recover() finishes or undoes what a crash has left at any point; every change begins with it.
"""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import storage
from ..sources.tables import MissingBatch, batch_names, read_merged

CODECS = ("snappy", "zstd", "gzip", "none", "uncompressed")
#: The name that compaction gives; all other names are used once.
COMPACTED = "b0000"


class Manifest:
    """What the table consists of: {table, snapshot, batches, next}; while a compaction is exchanged, its entry under "compacting"."""

    def __init__(self, path: str, table: str, snapshot: str):
        self.path = path
        held = storage.read_text(path)
        self.data = json.loads(held) if held else {"table": table, "snapshot": snapshot, "batches": [], "next": 0}
        if self.data["snapshot"] != snapshot:
            raise SystemExit(f"{path} is of snapshot {self.data['snapshot']}, not {snapshot}: they can't be mixed")

    @property
    def batches(self) -> list[dict]:
        return self.data["batches"]

    def done(self) -> set[str]:
        return {s for b in self.batches for s in b["shards"]}

    def next_name(self) -> str:
        """One more than the highest number ever given out, dropped and compacted batches included."""
        used = [int(b["batch"][1:]) for b in self.batches]
        return f"b{max([self.data.get('next', 0), *(n + 1 for n in used)]):04d}"

    def save(self) -> None:
        self.data["next"] = int(self.next_name()[1:])
        storage.write_text(self.path, json.dumps(self.data, indent=1))


def by_decade(df: DataFrame) -> DataFrame:
    """Rows dealt by decade; a decade that holds much of the table is split by size, small ones share a task.

    That is what Spark's rebalancing does as it runs, from the sizes that the shuffle has measured, with AQE on.
    """
    return df.hint("rebalance", F.col("decade"))


def write_partitioned(df: DataFrame, root: str, codec: str = "snappy", max_records: int = 2_000_000, cluster: tuple[str, ...] = ("country",), mode: str = "append") -> None:
    """One shuffle by decade, sorted within, so files are few and their row groups' statistics narrow."""
    inside = [c for c in ("decade", *cluster) if c in df.columns]
    placed = by_decade(df).sortWithinPartitions(*inside)
    placed.write.mode(mode).option("compression", codec).option("maxRecordsPerFile", max_records).partitionBy("ingest_batch", "decade").parquet(root)


# --- Recovery --------------------------------------------------------------------------------------------------------


def _staging(root: str, what: str) -> str:
    return f"{root}.staging-{what}"


def _old(root: str) -> str:
    return f"{root}.old"


def _siblings(root: str, kind: str) -> list[str]:
    parent, _, name = root.rstrip("/").rpartition("/")
    return [f"{parent}/{x}" for x in storage.folders(parent or "/", f"{name}.{kind}")]


def exchange(root: str, manifest: Manifest) -> None:
    """The compacted table takes the old one's place. Each step is one that a second run finds done or does."""
    new, entry = _staging(root, "compact"), manifest.data["compacting"]
    if storage.exists(new):
        if storage.exists(root):
            storage.rename(root, _old(root))
        storage.rename(new, root)
    manifest.data["batches"] = [entry]
    del manifest.data["compacting"]
    manifest.save()
    storage.delete(_old(root))


def recover(root: str, manifest: Manifest) -> list[str]:
    """Finish a compaction that the manifest announces; else the table in place, or the old one if there is none, is the table.

    Then staging folders and batches that the manifest doesn't name go. The names of such batches.
    """
    if "compacting" in manifest.data:
        exchange(root, manifest)
    if storage.exists(_old(root)):
        if storage.exists(root):
            storage.delete(_old(root))
        else:
            storage.rename(_old(root), root)
    known = {b["batch"] for b in manifest.batches}
    stale = [b for b in batch_names(root) if b not in known]
    for path in [*(f"{root}/ingest_batch={b}" for b in stale), *_siblings(root, "staging-")]:
        storage.delete(path)
    return stale


clean_leftovers = recover


# --- Changes ---------------------------------------------------------------------------------------------------------


def _now() -> str:
    return dt.datetime.now().isoformat(timespec="seconds")


def append_batch(spark: SparkSession, shards: list[str], root: str, manifest: Manifest, transform: Callable[[DataFrame], DataFrame], source_bytes: int = 0, codec: str = "snappy", max_records: int = 2_000_000) -> dict:
    """Read the shards, transform, append as the next batch; the entry of the manifest."""
    began = time.time()
    recover(root, manifest)
    name = manifest.next_name()
    staging, part = _staging(root, name), f"ingest_batch={name}"
    rows = transform(spark.read.parquet(*shards)).withColumn("ingest_batch", F.lit(name))
    write_partitioned(rows, staging, codec, max_records)
    if storage.exists(f"{staging}/{part}"):  # shards without a row make none
        storage.rename(f"{staging}/{part}", f"{root}/{part}")
        n = spark.read.option("basePath", root).parquet(f"{root}/{part}").count()
    else:
        n = 0
    storage.delete(staging)
    entry = {"batch": name, "shards": sorted(shards), "source_bytes": source_bytes, "rows": n, "seconds": round(time.time() - began, 1), "at": _now()}
    manifest.batches.append(entry)
    manifest.save()
    return entry


def compact(spark: SparkSession, root: str, manifest: Manifest, codec: str = "snappy", max_records: int = 2_000_000) -> dict:
    """All batches rewritten as one; until the new table is whole and announced, the old one is the table."""
    began = time.time()
    recover(root, manifest)
    if len(manifest.batches) < 2:
        raise SystemExit("compaction needs two batches")
    rows = read_merged(spark, root).drop("ingest_batch").withColumn("ingest_batch", F.lit(COMPACTED))
    write_partitioned(rows, _staging(root, "compact"), codec, max_records, mode="overwrite")
    entry = {
        "batch": COMPACTED,
        "shards": sorted(s for b in manifest.batches for s in b["shards"]),
        "source_bytes": sum(b["source_bytes"] for b in manifest.batches),
        "rows": sum(b["rows"] for b in manifest.batches),
        "seconds": round(time.time() - began, 1),
        "at": _now(),
    }
    manifest.data["compacting"] = entry
    manifest.save()
    exchange(root, manifest)
    return entry


def drop_batch(root: str, manifest: Manifest, name: str) -> None:
    """Roll a batch back: out of the manifest first, then off the disk."""
    recover(root, manifest)
    if name not in {b["batch"] for b in manifest.batches}:
        raise MissingBatch(f"no such batch: {name}")
    manifest.save()  # its number counts as used
    manifest.data["batches"] = [b for b in manifest.batches if b["batch"] != name]
    manifest.save()
    storage.delete(f"{root}/ingest_batch={name}")


# --- Other writers ---------------------------------------------------------------------------------------------------


def write_result(df: DataFrame, path: str, one_file: bool = True, codec: str = "zstd") -> None:
    """A small result table. one_file uses coalesce(1), so it is for aggregates alone."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("compression", codec).parquet(path)


#: Ways to lay a table out: how rows are dealt before the write, and what folders they go to.
LAYOUTS = ("as_is", "coalesce", "round_robin", "partition_by", "repartition_partition_by", "two_levels")


def write_layout(df: DataFrame, path: str, layout: str, key: str = "decade", n: int = 8, codec: str = "snappy", second: str = "country") -> None:
    """The layouts that are compared: as it is, coalesced, round robin, partitioned with and without a repartition, by two columns."""
    if layout not in LAYOUTS:
        raise ValueError(f"no such layout: {layout}")
    placed = {"coalesce": lambda: df.coalesce(n), "round_robin": lambda: df.repartition(n), "repartition_partition_by": lambda: df.repartition(key), "two_levels": lambda: df.repartition(key, second)}.get(layout, lambda: df)()
    writer = placed.write.mode("overwrite").option("compression", codec)
    folders = [key, second] if layout == "two_levels" else [key] if layout.endswith("partition_by") else []
    (writer.partitionBy(*folders) if folders else writer).parquet(path)


def append_line(path: str, row: dict) -> None:
    """A line more in a small log; the file is replaced, as not every store can append."""
    storage.write_text(path, (storage.read_text(path) or "") + json.dumps(row, default=str) + "\n")
