"""Ingestion, compaction, rollback, the nine-stage job, the stream."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fieldmark import config
from fieldmark.plans import demo, job
from fieldmark.plans.curate import curate
from fieldmark.sinks import ingest
from fieldmark.sources import registry, shards, tables
from fieldmark.streaming.ingest import ingest_available

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("source")
    raw = demo.raw_records(spark, SF)
    for i in range(4):
        raw.where(F.col("gbifid") % 4 == i).coalesce(1).write.parquet(f"{root}/shard{i}")
    return str(root)


@pytest.fixture
def lake(spark, source, tmp_path):
    root, manifest = str(tmp_path / "facts"), ingest.Manifest(str(tmp_path / "m.json"), "facts", source)
    listing = shards.list_local(source)
    for part in (listing[:2], listing[2:]):
        ingest.append_batch(spark, [k for k, _ in part], root, manifest, curate, sum(s for _, s in part))
    return root, manifest


def test_batches_append_and_read_back(spark, lake):
    root, manifest = lake
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert [b["batch"] for b in manifest.batches] == ["b0000", "b0001"] == tables.batch_names(root)
    assert sum(b["rows"] for b in manifest.batches) == n == tables.read_table(spark, root).count()
    one = tables.read_table(spark, root, ["b0001"])
    assert {"ingest_batch", "decade"} <= set(one.columns) and one.count() == manifest.batches[1]["rows"]
    with pytest.raises(SystemExit):
        tables.read_table(spark, root, ["b0009"])


def test_names_are_not_used_again(lake):
    root, manifest = lake
    ingest.drop_batch(root, manifest, "b0000")
    assert manifest.next_name() == "b0002" and tables.batch_names(root) == ["b0001"]
    with pytest.raises(SystemExit):
        ingest.drop_batch(root, manifest, "b0000")


def test_leftovers_of_a_crash_go(spark, lake, source):
    root, manifest = lake
    lost = manifest.batches.pop()  # data moved, the manifest not written
    manifest.save()
    assert ingest.clean_leftovers(root, manifest) == [lost["batch"]]
    entry = ingest.append_batch(spark, lost["shards"], root, manifest, curate)
    assert entry["rows"] == lost["rows"] and tables.read_table(spark, root).count() == sum(b["rows"] for b in manifest.batches)


def test_compaction_keeps_rows(spark, lake):
    root, manifest = lake
    rows, done = sum(b["rows"] for b in manifest.batches), manifest.done()
    ingest.compact(spark, root, manifest)
    assert tables.batch_names(root) == ["b0000"] and spark.read.parquet(root).count() == rows and manifest.done() == done
    with pytest.raises(SystemExit):
        ingest.compact(spark, root, manifest)


def test_manifest_refuses_another_snapshot(lake):
    with pytest.raises(SystemExit):
        ingest.Manifest(str(lake[1].path), "facts", "other")


def test_job_adds_up(spark, lake, tmp_path):
    dim = str(tmp_path / "dim")
    ingest.write_result(demo.publishers(spark, SF), dim)
    cfg = job.Config(table=lake[0], dim=dim, out=str(tmp_path / "out"), least_records=100)
    summary = job.run(spark, cfg, quiet=True)
    assert all(summary["verified"].values()) and summary["facts"] == summary["headline"]["records"]
    assert set(p.name for p in Path(cfg.out).iterdir()) == {"headline", "by_dataset", "by_publisher", "variance", *job.BREAKDOWNS, *job.FLAG_TABLES}
    assert 0 <= summary["variance"]["between_share"] <= 1 and job.verdict(summary["variance"])
    job.record(str(tmp_path / "runs.jsonl"), summary)
    assert registry.read_jsonl(str(tmp_path / "runs.jsonl"))[0]["facts"] == summary["facts"]
    late = job.run(spark, job.Config(table=lake[0], dim=dim, out=str(tmp_path / "out2"), least_records=100, write_in_place=False, cache="memory_and_disk", join="sortmerge", cache_results=False), quiet=True)
    assert late["headline"]["usable"] == pytest.approx(summary["headline"]["usable"], abs=1e-9)


def test_stream_takes_each_file_once(spark, source, tmp_path):
    schema = spark.read.parquet(f"{source}/shard0").schema
    args = (f"{source}/*", schema, str(tmp_path / "t"), str(tmp_path / "c"), curate)
    assert ingest_available(spark, *args, max_files=2) == 2
    assert ingest_available(spark, *args, max_files=2) == 0
    assert spark.read.parquet(str(tmp_path / "t")).count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_layouts(spark, tmp_path):
    df = demo.facts(spark, SF).select("gbifid", "decade", "country")
    for layout in ("as_is", "coalesce", "round_robin", "partition_by", "repartition_partition_by"):
        ingest.write_layout(df, str(tmp_path / layout), layout, n=3)
        assert spark.read.parquet(str(tmp_path / layout)).count() == df.count()
    assert len(tables.files_of(str(tmp_path / "round_robin"))) == 3


def test_shard_picks():
    listing = [(f"k{i:03d}", (i % 7 + 1) << 20) for i in range(100)]
    first, size = shards.spread_pick(listing, 0.05)
    again, _ = shards.spread_pick(listing, 0.05, set(first))
    assert first and again and not set(first) & set(again) and size == sum(dict(listing)[k] for k in first)
    assert shards.spread_pick(listing, 1e9)[0] == [k for k, _ in listing] and shards.spread_pick([], 1) == ([], 0)
    assert shards.head_pick(listing, 1e-9)[0] == ["k000"]


def test_bucket_listing_pages_and_caches(tmp_path):
    page = "<L xmlns='x'>{}<NextContinuationToken>{}</NextContinuationToken></L>"
    item = "<Contents><Key>{}</Key><Size>{}</Size></Contents>"
    calls = []

    def fetch(url):
        calls.append(url)
        return (page.format(item.format("p/b", 2), "t") if "continuation" not in url else page.format(item.format("p/a", 1) + item.format("p/", 0), "")).encode()

    cache = str(tmp_path / "c.json")
    assert shards.list_bucket("http://x", "p/", fetch, cache) == [("p/a", 1), ("p/b", 2)] == shards.list_bucket("http://x", "p/", fetch, cache)
    assert len(calls) == 2


def test_registry_retries_and_completes_the_cache(tmp_path):
    import io
    import urllib.error

    tries = {}

    def get(url):
        key = url.rsplit("/", 1)[1]
        tries[key] = tries.get(key, 0) + 1
        if key == "gone":
            raise urllib.error.HTTPError(url, 404, "", None, io.BytesIO())
        if tries[key] == 1:
            raise urllib.error.URLError("busy")
        return json.dumps({"title": f" {key} ", "publishingOrganizationKey": "o"}).encode()

    cache = str(tmp_path / "d.jsonl")
    call = lambda keys: registry.fetch_missing(keys, cache, "datasetkey", "http://r/{key}", registry.slim_dataset, get, pause=lambda s: None)
    rows = {r["datasetkey"]: r for r in call(["a", "gone"])}
    assert rows["a"]["dataset_title"] == "a" and rows["a"]["found"] and not rows["gone"]["found"] and tries == {"a": 2, "gone": 1}
    assert len(call(["a", "b"])) == 3 and tries["a"] == 2


def test_dimension_from_caches(spark, tmp_path):
    from fieldmark.plans import dimension

    d, o = str(tmp_path / "d.jsonl"), str(tmp_path / "o.jsonl")
    registry.write_jsonl(d, [registry.slim_dataset("d1", {"license": "http://c/licenses/by/4.0/x", "publishingOrganizationKey": "o1", "created": "2010-01-01T00:00:00"}), registry.slim_dataset("d2", None)])
    registry.write_jsonl(o, [registry.slim_organisation("o1", {"title": "Org", "country": "se", "numPublishedDatasets": 3})])
    rows = {r.datasetkey: r for r in dimension.from_cache(spark, d, o).collect()}
    assert (rows["d1"].license, rows["d1"].publisher_country, rows["d1"].dataset_year, rows["d1"].publisher_datasets) == ("CC_BY_4_0", "SE", 2010, 3)
    assert (rows["d2"].license, rows["d2"].publisher_key, rows["d2"].publisher_title) == ("UNSPECIFIED", "UNKNOWN", None)


def test_paths_and_cli(monkeypatch, tmp_path, capsys):
    from fieldmark import cli

    monkeypatch.setenv("FIELDMARK_HOME", str(tmp_path))
    assert config.default_paths().facts == str(tmp_path.resolve() / "facts")
    cli.main(["curate", "status"])
    cli.main(["job", "--report"])
    assert "no batch yet" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["job"])
    a = cli.parser().parse_args(["data", "--source", "x", "--gb", "1"])
    titles = [(t, decide()[0]) for t, decide in cli.data_steps(config.default_paths(), a)]
    assert [c[:2] for _, c in titles] == [["curate", "build"], ["registry", "keys"], ["registry", "fetch"], ["registry", "build"]]
