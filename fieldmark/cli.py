"""Command line: curate, registry, job, all, data, status, test.

    python -m fieldmark curate build --source DIR|s3a://BUCKET/PREFIX --gb 2 [--pick spread|head]
    python -m fieldmark curate status|preview|compact|drop-batch NAME
    python -m fieldmark registry keys|fetch [--refresh]|build|status|show
    python -m fieldmark job [options]            python -m fieldmark job --report
    python -m fieldmark experiment NAME
    python -m fieldmark all --source DIR --gb 2  builds what is missing, then runs the job
"""

from __future__ import annotations

import argparse
import json
import subprocess
import sys
import time

from pyspark.sql import functions as F

from . import config
from .functions.scalars import share
from .measure.metrics import readable_bytes, table_text
from .plans import curate, dimension, job
from .session import build_session
from .sinks import ingest
from .sources import objectstore, registry, shards, storage, tables

#: A table that holds this share of the target is taken as full.
SLACK = 0.9
REGISTRY_URL = "https://registry.invalid/v1"  # --url names the real one


def newer(path: str, *than: str) -> bool:
    """Whether path exists and is as new as each of the others that exists."""
    own = storage.modified(path)
    return own is not None and all((other := storage.modified(p)) is None or own >= other for p in than)


def _manifest(p: config.Paths, snapshot: str | None = None) -> ingest.Manifest:
    if snapshot is None:
        snapshot = json.loads(storage.read_text(p.manifest) or '{"snapshot": "local"}')["snapshot"]
    return ingest.Manifest(p.manifest, p.facts, snapshot)


# --- curate ----------------------------------------------------------------------------------------------------------


def curate_build(p: config.Paths, a: argparse.Namespace) -> None:
    spark = build_session(extra=objectstore.settings(a.source, a.region, a.endpoint, a.connector))
    manifest = _manifest(p, a.source)
    ingest.recover(p.facts, manifest)
    listing = objectstore.list_shards(a.source, p.listing, a.refresh, a.region, a.endpoint)
    keys, size = shards.PICKERS[a.pick](listing, a.gb, manifest.done())
    if not keys:
        print("every shard is in the table")
        return
    print(f"{len(keys)} of {len(listing)} shards, {readable_bytes(size)} of {shards.total_gb(listing):.2f} GB")
    entry = ingest.append_batch(spark, keys, p.facts, manifest, curate.curate, size, a.codec, a.max_records)
    print(f"{entry['batch']}: {entry['rows']:,} rows of {len(keys)} shards, {readable_bytes(size)}, {entry['seconds']} s")


def curate_status(p: config.Paths, a: argparse.Namespace) -> None:
    rows = [{"batch": b["batch"], "shards": len(b["shards"]), "source": readable_bytes(b["source_bytes"]), "rows": b["rows"], "at": b["at"]} for b in _manifest(p).batches]
    print(table_text(rows) if rows else "no batch yet")
    if storage.exists(p.facts):
        print(table_text(tables.size_histogram(tables.file_sizes(p.facts))))


GATES = ["has_species", "has_coords", "coord_valid", "has_geo_issue", "year_known", "is_present", "uncertainty_known", "uncertainty_ok", "usable_for_mapping"]


def curate_preview(p: config.Paths, a: argparse.Namespace) -> None:
    facts = tables.read_merged(build_session(), p.facts)
    facts.printSchema()
    gate_shares(facts, GATES).show(truncate=False)
    usable_by_decade(facts).show(50)


def gate_shares(facts, gates):
    """A row a boolean column: its share of true."""
    wide = facts.agg(*[share(g).alias(g) for g in gates])
    return wide.selectExpr(f"stack({len(gates)}, {', '.join(f'{chr(39)}{g}{chr(39)}, {g}' for g in gates)}) as (gate, share)")


def usable_by_decade(facts):
    strict = F.col("usable_for_mapping") & F.col("uncertainty_known")
    return facts.groupBy("decade").agg(F.count(F.lit(1)).alias("records"), share("usable_for_mapping").alias("usable"), share(strict).alias("usable_strict")).orderBy("decade")


def curate_compact(p: config.Paths, a: argparse.Namespace) -> None:
    print(ingest.compact(build_session(), p.facts, _manifest(p), a.codec, a.max_records))


def curate_drop(p: config.Paths, a: argparse.Namespace) -> None:
    ingest.drop_batch(p.facts, _manifest(p), a.name)
    print(f"{a.name} is gone")


# --- registry --------------------------------------------------------------------------------------------------------


def registry_keys(p: config.Paths, a: argparse.Namespace) -> None:
    rows = tables.read_merged(build_session(), p.facts).select("datasetkey").distinct().collect()  # a key a dataset
    storage.write_text(p.keys, json.dumps(sorted(r[0] for r in rows if r[0])))
    print(f"{len(rows)} datasets")


def registry_fetch(p: config.Paths, a: argparse.Namespace) -> None:
    keys = json.loads(storage.read_text(p.keys) or "[]")
    found = registry.fetch_missing(keys, p.datasets, "datasetkey", a.url + "/dataset/{key}", registry.slim_dataset, refresh=a.refresh)
    orgs = registry.fetch_missing([r["publisher_key"] for r in found], p.organisations, "publisher_key", a.url + "/organization/{key}", registry.slim_organisation, refresh=a.refresh)
    print(f"{len(found)} datasets, {len(orgs)} organisations")


def registry_build(p: config.Paths, a: argparse.Namespace) -> None:
    spark = build_session()
    ingest.write_result(dimension.from_cache(spark, p.datasets, p.organisations), p.dimension, codec="snappy")
    limit = int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b"))
    size = tables.table_bytes(p.dimension)
    print(f"{readable_bytes(size)}: {'under' if size <= limit else 'over'} the broadcast threshold")


def registry_status(p: config.Paths, a: argparse.Namespace) -> None:
    for name in ("datasets", "organisations"):
        rows = registry.read_jsonl(getattr(p, name))
        print(f"{name}: {len(rows)} cached, {sum(not r['found'] for r in rows)} not found")


def registry_show(p: config.Paths, a: argparse.Namespace) -> None:
    for name, df in dimension.report(build_session().read.parquet(p.dimension)).items():
        print(name)
        df.show(20, truncate=False)


# --- job -------------------------------------------------------------------------------------------------------------


def job_config(p: config.Paths, a: argparse.Namespace) -> job.Config:
    told = {
        "spark.sql.shuffle.partitions": a.shuffle_partitions,
        "spark.sql.files.maxPartitionBytes": a.max_partition_bytes,
        "spark.sql.adaptive.enabled": "false" if a.no_aqe else None,
        "spark.sql.adaptive.skewJoin.enabled": "false" if a.no_skew_join else None,
        "spark.driver.memory": a.driver_memory,
    }
    return job.Config(
        table=a.table or p.facts,
        dim=a.dim or p.dimension,
        out=a.out or p.results,
        batches=tuple(x for x in a.batches.split(",") if x),
        cache="none" if a.no_cache else a.cache,
        join=a.join,
        write_in_place=not a.no_write_in_place,
        cache_results=not a.no_cache_results,
        coalesce_output=not a.no_coalesce_output,
        tag=a.tag,
        session={key: value for key, value in told.items() if value is not None},
    )


def run_job(p: config.Paths, a: argparse.Namespace) -> None:
    if a.report:
        rows = [{"at": r["at"], "tag": r["config"]["tag"], "wall": f"{r['wall']:.1f}", "cache": r["config"]["cache"], "join": r["config"]["join"], "usable": f"{r['headline']['usable']:.4f}"} for r in registry.read_jsonl(p.runs)]
        print(table_text(rows) if rows else "no run yet")
        return
    cfg = job_config(p, a)
    if missing := job.missing_inputs(cfg):
        raise SystemExit("missing: " + "; ".join(missing))
    print(cfg.describe())
    summary = job.run(job.session_for(cfg), cfg)
    job.record(p.runs, summary)
    print(job.answer_text(summary))
    if not all(summary["verified"].values()):
        raise SystemExit(f"results do not add up: {summary['verified']}")


# --- all -------------------------------------------------------------------------------------------------------------


def store_options(a: argparse.Namespace) -> list[str]:
    return [x for name in ("region", "endpoint", "connector") if (value := getattr(a, name)) for x in (f"--{name}", value)]


def data_steps(p: config.Paths, a: argparse.Namespace):
    """(title, decide): decide() gives the command to run, or None and the reason why not. It is called just before the step."""

    def facts():
        have = sum(b["source_bytes"] for b in _manifest(p).batches) / shards.GIB
        return (None, f"the table holds {have:.2f} GB") if have >= SLACK * a.gb else (["curate", "build", "--source", a.source, "--gb", f"{a.gb - have:.4f}", *store_options(a)], None)

    def keys():
        return (None, "the key list is newer than the manifest") if not a.force and newer(p.keys, p.manifest) else (["registry", "keys"], None)

    def fetch():
        return ["registry", "fetch", "--url", a.url], None

    def build():
        return (None, "the dimension is newer than the caches") if not a.force and newer(f"{p.dimension}/_SUCCESS", p.datasets, p.organisations) else (["registry", "build"], None)

    return [("fact table", facts), ("dataset keys", keys), ("registry", fetch), ("dimension", build)]


def run_steps(steps) -> list[dict]:
    """Each step in a process of its own, and so in a JVM of its own; stops at the first that fails."""
    log = []
    for title, decide in steps:
        command, reason = decide()
        began = time.time()
        code = subprocess.run([sys.executable, "-m", "fieldmark", *command]).returncode if command else 0
        log.append({"step": title, "did": "skipped: " + reason if reason else "ok" if code == 0 else f"failed ({code})", "s": round(time.time() - began, 1)})
        if code:
            break
    print(table_text(log))
    return log


def build_all(p: config.Paths, a: argparse.Namespace) -> None:
    steps = data_steps(p, a)
    if a.command == "all":
        steps.append(("job", lambda: (["job", "--tag", "end-to-end"], None)))
    if any(x["did"].startswith("failed") for x in run_steps(steps)):
        raise SystemExit(1)


def show_status(p: config.Paths, a: argparse.Namespace) -> None:
    curate_status(p, a)
    registry_status(p, a)
    a.report = True
    run_job(p, a)


def run_experiment(p: config.Paths, a: argparse.Namespace) -> None:
    from .plans import experiments as x

    if a.name == "before_after":
        rows = x.before_after({"before": ["--cache", "memory_and_disk", "--no-write-in-place", "--no-cache-results"], "after": []})
        rows = [{k: v for k, v in r.items() if k != "output"} for r in rows]
    else:
        cfg = job.Config(table=p.facts, dim=p.dimension, out=p.results, tag=a.name)
        rows = x.EXPERIMENTS[a.name](job.session_for(cfg), cfg)
    x.write_report(p.reports, a.name, rows)
    print(table_text(rows))


def run_tests(p: config.Paths, a: argparse.Namespace) -> None:
    raise SystemExit(subprocess.run([sys.executable, "-m", "pytest", "-q", "tests"]).returncode)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fieldmark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="command", required=True)

    def add(to, name, run, *options):
        one = to.add_parser(name)
        for flags, kind in options:
            one.add_argument(*flags, **kind)
        one.set_defaults(run=run)

    source = [(["--source"], {"required": True, "help": "a folder, or s3a://bucket/prefix"}), (["--gb"], {"type": float, "default": 2.0})]
    source += [([f"--{x}"], {}) for x in ("region", "endpoint")] + [(["--connector"], {"help": "version of the object store connector to fetch"})]
    write = [(["--codec"], {"choices": ingest.CODECS, "default": "snappy"}), (["--max-records"], {"type": int, "default": 2_000_000})]
    url = (["--url"], {"default": REGISTRY_URL})
    c = sub.add_parser("curate").add_subparsers(dest="what", required=True)
    add(c, "build", curate_build, *source, *write, (["--pick"], {"choices": list(shards.PICKERS), "default": "spread"}), (["--refresh"], {"action": "store_true"}))
    add(c, "status", curate_status)
    add(c, "preview", curate_preview)
    add(c, "compact", curate_compact, *write)
    add(c, "drop-batch", curate_drop, (["name"], {}))
    r = sub.add_parser("registry").add_subparsers(dest="what", required=True)
    add(r, "keys", registry_keys)
    add(r, "fetch", registry_fetch, url, (["--refresh"], {"action": "store_true"}))
    add(r, "build", registry_build)
    add(r, "status", registry_status)
    add(r, "show", registry_show)
    yes = {"action": "store_true"}
    add(
        sub,
        "job",
        run_job,
        *[([f"--{x}"], {"default": ""}) for x in ("table", "dim", "out", "batches")],
        (["--tag"], {"default": "default"}),
        (["--shuffle-partitions"], {}),
        (["--max-partition-bytes"], {}),
        (["--cache"], {"choices": list(job.CACHE_LEVELS), "default": "none"}),
        (["--join"], {"choices": ["auto", "broadcast", "sortmerge"], "default": "auto"}),
        (["--driver-memory"], {}),
        *[([f"--{x}"], yes) for x in ("no-aqe", "no-skew-join", "no-write-in-place", "no-cache-results", "no-coalesce-output", "no-cache", "report")],
    )
    for name in ("all", "data"):
        add(sub, name, build_all, *source, url, (["--force"], yes))
    experiments = "before_after caching input_packing join_strategies layouts profile pruning shuffle_partitions skew".split()
    add(sub, "experiment", run_experiment, (["name"], {"choices": experiments}))
    add(sub, "status", show_status)
    add(sub, "test", run_tests)
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(config.default_paths(), a)
