"""Experiments run and report; failures are told apart; fresh processes end."""

import json

import pytest

from fieldmark.plans import demo, experiments, job
from fieldmark.sinks import ingest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cfg(spark, tmp_path_factory):
    from pyspark.sql import functions as F

    root = tmp_path_factory.mktemp("lake")
    ingest.write_partitioned(demo.facts(spark, SF).withColumn("ingest_batch", F.lit("b0000")), f"{root}/facts")
    ingest.write_result(demo.publishers(spark, SF), f"{root}/dim")
    return job.Config(table=f"{root}/facts", dim=f"{root}/dim", out=f"{root}/out", least_records=100)


@pytest.mark.parametrize("name", ["input_packing", "pruning", "layouts", "join_strategies", "skew", "caching", "profile"])
def test_experiment(spark, cfg, name, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    rows = experiments.EXPERIMENTS[name](spark, cfg)
    assert len(rows) >= 3 and len({tuple(r) for r in rows}) == 1
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    experiments.write_report(str(tmp_path), name, rows)
    assert json.loads((tmp_path / f"{name}.json").read_text())["experiment"] == name
    if name == "join_strategies":
        assert [r["joins"] for r in rows][-1] == "SortMergeJoin" and rows[1]["joins"] == "BroadcastHashJoin"
    if name == "layouts":
        assert rows[2]["files"] == 8


def test_failures_are_told_apart():
    assert experiments.classify_failure("java.lang.OutOfMemoryError: heap") == "out of memory"
    assert experiments.classify_failure("disk: No space left on device") == "no space"
    assert experiments.classify_failure("?") == "failed"


def test_fresh_process(tmp_path):
    env = {"FIELDMARK_HOME": str(tmp_path)}
    assert experiments.run_fresh(["job"], 60, env)["outcome"] == "missing input"
    assert experiments.run_fresh(["curate", "status"], 60, env)["outcome"] == "ok"
    assert experiments.run_fresh(["curate", "status"], 0.01, env)["outcome"] == "timed out"
