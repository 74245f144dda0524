"""Ingestion that a crash may end at any point, hot partitions, one scan for the breakdowns, object stores, task quantiles."""

import collections
import json

import pytest
from pyspark.sql import functions as F

from fieldmark import cli
from fieldmark.measure.metrics import Rest, measure
from fieldmark.measure.plans import scan_stats
from fieldmark.operators import aggregates
from fieldmark.plans import demo, job, queries
from fieldmark.plans.curate import curate
from fieldmark.plans.experiments import settings
from fieldmark.sinks import ingest
from fieldmark.sources import objectstore, shards, storage, tables

SF = "/root/testdata/sf0.001"


class Crash(Exception):
    pass


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    raw = demo.raw_records(spark, SF)
    for i in range(3):
        raw.where(F.col("gbifid") % 3 == i).coalesce(1).write.parquet(f"{root}/shard{i}")
    return str(root)


def table_of(spark, source, folder):
    root, manifest = f"{folder}/facts", ingest.Manifest(f"{folder}/m.json", "facts", source)
    for key, size in shards.list_folder(source)[:2]:
        ingest.append_batch(spark, [key], root, manifest, curate, size)
    return root, manifest


def ids(spark, root):
    return collections.Counter(r[0] for r in tables.read_merged(spark, root).select("gbifid").collect())


# --- Files ---------------------------------------------------------------------------------------------------------------


def test_files(spark, tmp_path):
    path = f"{tmp_path}/a/b.json"
    assert storage.read_text(path) is None and storage.modified(path) is None and storage.files(f"{tmp_path}/none") == [] and storage.folders(f"{tmp_path}/none") == []
    storage.write_text(path, "öne")
    storage.write_text(path, "two")
    assert storage.read_text(path) == "two" == storage.read_text(f"file://{path}") and storage.modified(path) > 0
    assert [n for n, _ in storage.files(f"{tmp_path}/a")] == [path] and storage.folders(str(tmp_path)) == ["a"]  # nothing is left beside it
    storage.write_text(f"{tmp_path}/c/x", "")
    with pytest.raises(FileExistsError):
        storage.rename(f"{tmp_path}/c", f"{tmp_path}/a")
    storage.rename(f"{tmp_path}/c", f"{tmp_path}/d/e")
    assert storage.exists(f"{tmp_path}/d/e/x") and not storage.exists(f"{tmp_path}/c")
    ingest.append_line(f"{tmp_path}/log.jsonl", {"n": 1})
    ingest.append_line(f"{tmp_path}/log.jsonl", {"n": 2})
    assert [json.loads(x)["n"] for x in storage.read_text(f"{tmp_path}/log.jsonl").splitlines()] == [1, 2]


# --- Crashes -------------------------------------------------------------------------------------------------------------


def crash_at(monkeypatch, n):
    """The n-th change of the storage (a rename, a deletion, a written file) does not happen, nor any after it."""
    left = [n]

    def guarded(f):
        def run(*a, **k):
            left[0] -= 1
            if left[0] < 0:
                raise Crash
            return f(*a, **k)

        return run

    for name in ("rename", "delete", "write_text"):
        monkeypatch.setattr(storage, name, guarded(getattr(storage, name)))
    return left


@pytest.mark.parametrize("n", range(7))
def test_compaction_survives_a_crash_anywhere(spark, source, tmp_path, monkeypatch, n):
    root, manifest = table_of(spark, source, tmp_path)
    want, done = ids(spark, root), manifest.done()
    with monkeypatch.context() as m:
        left = crash_at(m, n)
        try:
            ingest.compact(spark, root, manifest)
        except Crash:
            pass
        crashed = left[0] < 0
    again = ingest.Manifest(manifest.path, "facts", source)  # a new process reads what is on the disk
    ingest.recover(root, again)
    assert ids(spark, root) == want and again.done() == done
    assert tables.batch_names(root) == sorted(b["batch"] for b in again.batches)
    assert storage.folders(str(tmp_path)) == ["facts"]
    assert crashed or n >= 5
    entry = ingest.append_batch(spark, [shards.list_folder(source)[2][0]], root, again, curate)
    assert entry["batch"] == "b0002" and sum(ids(spark, root).values()) == sum(want.values()) + entry["rows"]


@pytest.mark.parametrize("n", range(4))
def test_appending_survives_a_crash_anywhere(spark, source, tmp_path, monkeypatch, n):
    root, manifest = table_of(spark, source, tmp_path)
    want = ids(spark, root)
    third = shards.list_folder(source)[2][0]
    with monkeypatch.context() as m:
        crash_at(m, n)
        try:
            ingest.append_batch(spark, [third], root, manifest, curate)
        except Crash:
            pass
    again = ingest.Manifest(manifest.path, "facts", source)
    ingest.recover(root, again)
    if third not in again.done():
        assert ids(spark, root) == want
        ingest.append_batch(spark, [third], root, again, curate)
    assert ids(spark, root) == collections.Counter(r[0] for r in demo.raw_records(spark, SF).select("gbifid").collect())
    assert sum(b["rows"] for b in again.batches) == sum(ids(spark, root).values()) and storage.folders(str(tmp_path)) == ["facts"]


def test_old_table_comes_back(spark, source, tmp_path):
    """What a release without announced compactions may have left: the table under its old name alone."""
    root, manifest = table_of(spark, source, tmp_path)
    want = ids(spark, root)
    storage.rename(root, f"{root}.old")
    storage.make_folder(f"{root}.staging-compact/ingest_batch=b0000")
    ingest.recover(root, manifest)
    assert ids(spark, root) == want and storage.folders(str(tmp_path)) == ["facts"]


def test_the_highest_name_is_not_used_again(spark, source, tmp_path):
    root, manifest = table_of(spark, source, tmp_path)
    ingest.drop_batch(root, manifest, "b0001")
    assert manifest.next_name() == "b0002" == ingest.Manifest(manifest.path, "facts", source).next_name()
    entry = ingest.append_batch(spark, [shards.list_folder(source)[1][0]], root, manifest, curate)
    assert entry["batch"] == "b0002"
    ingest.compact(spark, root, manifest)
    assert manifest.next_name() == "b0003"


# --- Hot partitions, layouts, pruning ------------------------------------------------------------------------------------


def test_a_hot_decade_is_written_by_many_tasks(spark, tmp_path):
    """A decade with nine tenths of the rows: AQE splits what the shuffle finds large."""
    rows = spark.range(0, 400_000, 1, 16).selectExpr("id as gbifid", "if(id % 10 = 0, 1900 + 10 * (id % 7), 2020) as decade", "sha2(cast(id as string), 512) as country", "'b0000' as ingest_batch")
    with settings(spark, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m", "spark.sql.shuffle.partitions": "97"}):
        ingest.write_partitioned(rows, f"{tmp_path}/t", cluster=())
    files = collections.Counter(p.split("decade=")[1][:4] for p, _ in tables.files_of(f"{tmp_path}/t"))
    assert files["2020"] >= 4 and spark.read.parquet(f"{tmp_path}/t").count() == 400_000
    assert all(n <= 2 for d, n in files.items() if d != "2020")  # small decades are not scattered


def test_two_levels_are_pruned(spark, tmp_path):
    df = demo.facts(spark, SF).select("gbifid", "decade", F.coalesce("country", F.lit("none")).alias("country"))
    ingest.write_layout(df, f"{tmp_path}/two", "two_levels")
    assert storage.folders(f"{tmp_path}/two") and all(x.startswith("decade=") for x in storage.folders(f"{tmp_path}/two"))
    some = spark.read.parquet(f"{tmp_path}/two").where("decade = 1990 and country = 'SE'")
    with measure(spark, "pruned"):
        n = some.count()
    assert n == df.where("decade = 1990 and country = 'SE'").count() > 0
    told = scan_stats(some)
    assert "decade" in told["partition_filters"][0] and "country" in told["partition_filters"][0] and told["pushed_filters"] in ([], ["["], [""])
    files = {r[0] for r in some.select(F.input_file_name()).distinct().collect()}
    assert files and all("decade=1990/country=SE" in f for f in files)


# --- The job ---------------------------------------------------------------------------------------------------------------


def test_breakdowns_of_the_job_scan_once(spark, source, tmp_path):
    root, _ = table_of(spark, source, tmp_path)
    dim = f"{tmp_path}/dim"
    ingest.write_result(demo.publishers(spark, SF), dim)
    cfg = job.Config(table=root, dim=dim, out=f"{tmp_path}/out", least_records=50)
    held = []
    results = job.results_of(job.enriched(spark, cfg), cfg, held)
    assert len(held) == 2
    for name in job.BREAKDOWNS:
        results[name].collect()
        assert "InMemoryTableScan" in results[name]._jdf.queryExecution().executedPlan().toString()
    wide = held[1]
    infos = [r for r in spark.sparkContext._jsc.sc().getRDDStorageInfo()]
    assert any(i.isCached() for i in infos)  # computed once, read five times
    assert {r["decade"] for r in results["by_decade"].collect()} == {r[0] for r in tables.read_table(spark, root).select("decade").distinct().collect()}
    for df in held:
        df.unpersist()
    assert wide.columns[:1] == ["decade"]
    columns = job.columns_read(job.results_of(job.enriched(spark, cfg), cfg))
    assert {"usable_for_mapping", "n_issues", "specieskey", "cell_id", "datasetkey", "decade"} <= columns and "scientificname" not in columns


def test_settings_of_a_run():
    cfg = job.Config("t", "d", "o", join="sortmerge", session={"spark.sql.shuffle.partitions": "7"})
    told = cfg.settings()
    assert told["spark.sql.shuffle.partitions"] == "7" and told["spark.sql.autoBroadcastJoinThreshold"] == "-1" and told["spark.sql.adaptive.enabled"] == "true"
    a = cli.parser().parse_args(["job", "--no-aqe", "--max-partition-bytes", "33554432", "--tag", "x", "--batches", "b0000,b0002"])
    from fieldmark import config

    cfg = cli.job_config(config.Paths("/h"), a)
    assert cfg.session == {"spark.sql.adaptive.enabled": "false", "spark.sql.files.maxPartitionBytes": "33554432"} and cfg.batches == ("b0000", "b0002") and cfg.table == "/h/facts"


def test_variance_far_from_zero(spark):
    """Means 1e8 and 1e8 + 0.002: the variance between them keeps its digits."""
    rows = [(g, 1e8 + g * 0.002 + d) for g in (0, 1) for d in (-0.001, 0.0, 0.001)]
    got = aggregates.variance_decomposition(spark.createDataFrame(rows, "g int, x double"), "g", "x").first()
    assert got.between == pytest.approx(1e-6, rel=1e-3) and got.within == pytest.approx(2e-6 / 3, rel=1e-3) and got.datasets == 6


# --- Sketches, sorts, joins, placement ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("name, exact", [("headline_hll", "headline"), ("by_publisher_hll", "by_publisher"), ("cardinality_profile_hll", "cardinality_profile")])
def test_sketches_are_within_their_error(spark, name, exact):
    """Three relative standard deviations, the sketch's own; all other columns agree."""
    keys = {"headline": [], "by_publisher": ["publisher_key", "publisher_title", "publisher_country"], "cardinality_profile": ["column_name"]}[exact]
    rsd = 0.05 if "cardinality" in name else aggregates.RSD
    distinct = {"species", "cells", "publishers", "datasets", "n_distinct", "per_row"}
    rows = lambda q: {tuple(r[k] for k in keys): r for r in queries.QUERIES[q](spark, "/root/testdata/sf0.01").collect()}
    sketched, counted = rows(name), rows(exact)
    assert set(sketched) == set(counted)
    for key, r in sketched.items():
        for c in r.asDict():
            if c in distinct:
                assert abs(r[c] - counted[key][c]) <= 3 * rsd * counted[key][c] + 1e-9
            elif isinstance(r[c], float):
                assert r[c] == pytest.approx(counted[key][c])
            else:
                assert r[c] == counted[key][c]


def test_sorts_and_anti_join_have_rows(spark):
    got = [(r.n_regionkey, r.n_name) for r in queries.QUERIES["sort_multi"](spark, SF).collect()]
    assert got == sorted(sorted(got, key=lambda r: r[1], reverse=True), key=lambda r: r[0]) and len(got) == 25
    assert queries.QUERIES["join_anti"](spark, "/root/testdata/sf0.01").count() > 0


def test_placement_ties_are_broken(spark):
    df = spark.range(1000).selectExpr("id % 50 as k")
    got = aggregates.hash_placement(df, "k", 7).collect()
    assert sum(r["rows"] for r in got) == 1000 and sum(r["keys"] for r in got) == 50
    where = {r.k: r.p for r in df.distinct().select("k", F.pmod(F.hash("k"), F.lit(7)).alias("p")).collect()}
    assert {r.partition: r.largest for r in got} == {p: max(k for k, q in where.items() if q == p) for p in set(where.values())}


# --- Picking, object stores --------------------------------------------------------------------------------------------------


def test_spread_meets_its_budget():
    listing = [(f"k{i:04d}", ((i * 7919) % 97 + 1) << 20) for i in range(1000)]
    total = sum(s for _, s in listing)
    for part in (0.01, 0.1, 0.5, 0.9):
        keys, size = shards.spread_pick(listing, part * total / shards.GIB)
        assert abs(size - part * total) <= 97 << 20 and keys == sorted(set(keys))
        halves = sum(dict(listing)[k] for k in keys if k < "k0500")
        assert abs(halves - size / 2) < 0.15 * total
    assert shards.spread_pick(listing, 1e-9)[0] and len(shards.spread_pick(listing, 1e-9)[0]) == 1
    assert shards.head_pick(listing, 0.3, {"k0000"})[0][0] == "k0001" and shards.head_pick([], 1) == ([], 0)
    assert shards.head_pick(listing, 0.3)[1] <= 0.3 * shards.GIB and shards.total_gb(listing) == pytest.approx(total / shards.GIB)


def test_object_store(tmp_path, spark):
    told = objectstore.settings("s3a://open-data/occurrence/2025", "eu-central-1", None, "3.4.1")
    assert told["spark.hadoop.fs.s3a.endpoint.region"] == "eu-central-1" and told["spark.jars.packages"].endswith(":3.4.1") and "Anonymous" in told["spark.hadoop.fs.s3a.aws.credentials.provider"]
    assert objectstore.settings("/some/folder", "x") == {} and objectstore.split("s3a://b/p/q") == ("b", "p/q")
    asked = []

    def get(url):
        asked.append(url)
        return b"<L><Contents><Key>p/q/1.parquet</Key><Size>7</Size></Contents><Contents><Key>p/q/_meta</Key><Size>3</Size></Contents></L>"

    found = objectstore.list_shards("s3a://b/p", f"{tmp_path}/l.json", region="r", get=get)
    assert found == [("s3a://b/p/q/1.parquet", 7)] == objectstore.list_shards("s3a://b/p", f"{tmp_path}/l.json", region="r", get=get)
    assert len(asked) == 1 and asked[0].startswith("https://b.s3.r.amazonaws.com?list-type=2&prefix=p")
    assert objectstore.address("b", None, "http://store:9000/") == "http://store:9000/b"
    storage.write_text(f"{tmp_path}/d/x.parquet", "1234")
    assert objectstore.list_shards(f"{tmp_path}/d") == [(f"{tmp_path}/d/x.parquet", 4)]


def test_build_from_a_folder_by_command(spark, source, monkeypatch, tmp_path, capsys):
    monkeypatch.setenv("FIELDMARK_HOME", str(tmp_path))
    monkeypatch.setattr(cli, "build_session", lambda *a, **k: spark)
    for pick in ("head", "spread", "spread"):
        cli.main(["curate", "build", "--source", source, "--gb", "0.00005", "--pick", pick])
    cli.main(["curate", "status"])
    told = capsys.readouterr().out
    assert "1 of 3 shards" in told and "b0002" in told
    cli.main(["curate", "compact"])
    cli.main(["curate", "build", "--source", source, "--gb", "1"])
    assert "every shard is in the table" in capsys.readouterr().out
    assert tables.read_table(spark, f"{tmp_path}/facts").count() == demo.raw_records(spark, SF).count()


# --- Task quantiles ------------------------------------------------------------------------------------------------------------


def test_quantiles_of_tasks(spark):
    rest = Rest(spark)
    if not rest.base:  # this session has no UI
        assert rest.stages() == [] and rest.quantiles(0) == {}
        answers = {"taskSummary": {"duration": [1.0], "executorRunTime": [2.0], "jvmGcTime": [0.0], "diskBytesSpilled": [0.0], "inputMetrics": {"bytesRead": [5.0]}, "shuffleReadMetrics": {"readBytes": [6.0]}, "shuffleWriteMetrics": {"writeBytes": [7.0]}}}
        rest.json = lambda path: answers["taskSummary"] if "quantiles=0.05,0.25,0.5,0.75,0.95" in path else None
        told = rest.quantiles(3)
        assert told["duration_ms"] == [1.0] and told["read_bytes"] == [5.0] and told["shuffle_bytes"] == [7.0]
