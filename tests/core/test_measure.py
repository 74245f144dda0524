"""Metric strings, plan reading, operators' invariants."""

import pytest
from pyspark.sql import functions as F

from fieldmark.measure import metrics as M
from fieldmark.measure import plans as P
from fieldmark.operators import aggregates as A
from fieldmark.operators import flags, joins
from fieldmark.plans import demo
from fieldmark.sources.tables import size_histogram

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "text, want",
    [("18,175,670", 18175670), ("701.0 MiB", 701 * 2**20), ("total (min, med, max)\n2.0 s (1 ms, 2 ms, 3 ms)", 2000), ("total\n1.5 GiB (x)", 1.5 * 2**30), ("12 ms", 12), ("junk", 0), ("", 0), (None, 0), ("2 m", 120_000)],
)
def test_parse_metric(text, want):
    assert M.parse_metric(text) == want


@pytest.mark.parametrize("n, want", [(512, "512 B"), (2048, "2.00 KB"), (5 << 20, "5.00 MB"), (3 << 30, "3.00 GB"), (None, "0 B")])
def test_readable_bytes(n, want):
    assert M.readable_bytes(n) == want


@pytest.mark.parametrize("value, want", [("10485760", 10485760), ("10485760b", 10485760), ("200k", 200 << 10), ("64m", 64 << 20), ("1g", 1 << 30), ("-1", -1)])
def test_conf_bytes(value, want):
    class Fake:
        conf = {"k": value}

    assert M.conf_bytes(Fake, "k") == want


def test_measure_without_ui_does_not_wait(spark):
    with M.measure(spark, "nothing") as m:
        spark.range(10).count()
    assert m["seconds"] >= 0 and str(m).startswith("nothing") and m["tasks"] == 0


def test_small_helpers():
    assert M.break_even(10, 5) == 3 and M.break_even(1, 0) == float("inf")
    assert M.bottleneck({"read_bytes": 100, "shuffle_bytes": 1, "seconds": 5}, 10) == ("read", True)
    assert M.totals([{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]) == {"a": 3}
    assert [r["files"] for r in size_histogram([1, 2 << 20, 20 << 20, 100 << 20, 200 << 20])] == [1] * 5


def test_plans_tell_strategies(spark):
    li, s = demo.table(spark, SF, "lineitem"), demo.table(spark, SF, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    for mode, want in (("broadcast", "BroadcastHashJoin"), ("sortmerge", "SortMergeJoin")):
        j = li.select("l_suppkey", "l_orderkey").join(joins.hinted(s, mode), "l_suppkey")
        j.collect()
        assert P.join_strategies(j) == [want]
    with pytest.raises(ValueError):
        joins.hinted(s, "cross")
    one = li.where("l_orderkey > 5").select("l_partkey")
    stats = P.scan_stats(one)
    assert "GreaterThan(l_orderkey,5)" in stats["pushed_filters"][0] and "l_tax" not in stats["read_schema"][0]
    assert P.partition_count(one) >= 1 and "Scan" in P.explain_text(one)


def test_breakdowns_take_one_scan(spark):
    found = A.breakdowns(demo.enriched(spark, SF), {"a": ["decade"], "b": ["country"]})
    assert sum(r.records for r in found["a"].collect()) == sum(r.records for r in found["b"].collect()) == demo.facts(spark, SF).count()
    assert any(r.country is None for r in found["b"].collect())  # real nulls stay


def test_invariants(spark):
    f = demo.facts(spark, SF)
    before, after = f.agg(F.count(F.lit(1)), F.sum("n_issues")).first()
    assert flags.exploded(f).count() == after and flags.explosion(f).first()[:2] == (before, after)
    c, o = demo.table(spark, SF, "customer"), demo.table(spark, SF, "orders").withColumnRenamed("o_custkey", "c_custkey")
    assert c.join(o, "c_custkey", "left_semi").count() + c.join(o, "c_custkey", "left_anti").count() == c.count()
    cube = f.cube("decade", "country").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    sums = {r.g: r.n for r in cube.groupBy("g").agg(F.sum("n").alias("n")).collect()}
    assert set(sums) == {0, 1, 2, 3} and set(sums.values()) == {before}


def test_salted_join_keeps_every_row(spark):
    big = spark.range(1000).selectExpr("id", "if(id % 3 = 0, id % 7, 1) as k")
    small = spark.range(7).withColumnRenamed("id", "k").withColumn("v", F.col("k") * 2)
    salted, plain = joins.salted_join(big, small, "k", 4, "id"), big.join(small, "k")
    assert sorted(salted.select("id", "k", "v").collect()) == sorted(plain.select("id", "k", "v").collect())


def test_empty_inputs(spark):
    none = demo.enriched(spark, SF).where("false")
    assert A.headline(none).first().records == 0 and A.breakdown(none, "decade").count() == 0
    assert A.variance_decomposition(A.by_dataset(none, 1), "publisher_key", "mean_flags").first().between_share == 0
