"""Named queries over the supplied tables, each with the SQL that must give the same rows (none where SQL can't)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import flags, joins, udfs, windows
from . import demo
from .demo import DIM_SQL, ENRICHED_SQL, FACTS_SQL, enriched, facts, publishers, table
from .dimension import report

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: Datasets of so many records are ranked; the tables at hand have some 600 a dataset.
LEAST_RECORDS = 500


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def long(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def r6(c: str | Column) -> Column:
    return F.round(c, 6)


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: long(n) for n in names})


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Sums of fractions depend on their order in the last digits. Averages of integers don't, and aren't rounded."""
    return df.withColumns({n: r6(F.col(n)) for n in names})


def n() -> Column:
    return F.count(F.lit(1)).alias("records")


MEASURES = "count(*) as records, avg(cast(usable_for_mapping as int)) as usable, avg(n_issues) as mean_flags"


@query(f"with {ENRICHED_SQL} select decade::bigint as decade, publisher_key, {MEASURES} from enriched group by all")
def flagship(spark, d):
    return longs(A.breakdown(enriched(spark, d), "decade", "publisher_key"), "decade").orderBy("decade", "publisher_key")


# --- Scans, projections, predicates ----------------------------------------------------------------------------------


@query("select count(*) as records from lineitem")
def scan_count(spark, d):
    return table(spark, d, "lineitem").agg(n())


@query("select r_regionkey::bigint as r_regionkey, r_name, 'fixed' as label, 7::bigint as seven, null::varchar as nothing from region")
def literal_columns(spark, d):
    return table(spark, d, "region").select(long("r_regionkey").alias("r_regionkey"), "r_name", F.lit("fixed").alias("label"), long(F.lit(7)).alias("seven"), F.lit(None).cast("string").alias("nothing"))


@query("select l_orderkey, l_linenumber::bigint as l_linenumber, l_quantity + 45 as v from lineitem")
def chained_projection(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", long("l_linenumber").alias("l_linenumber"), F.col("l_quantity").alias("v"))
    for i in range(10):  # CollapseProject makes one projection of the ten
        df = df.withColumn("v", F.col("v") + i)
    return df


@query(f"with {FACTS_SQL} select gbifid, has_species, coord_valid, has_geo_issue, year_known, is_present, uncertainty_ok, uncertainty_known, usable_for_mapping from facts")
def curate_gate(spark, d):
    return facts(spark, d).select("gbifid", "has_species", "coord_valid", "has_geo_issue", "year_known", "is_present", "uncertainty_ok", "uncertainty_known", "usable_for_mapping")


@query(f"with {FACTS_SQL} select gbifid, decade::bigint as decade, interpreted_month, interpreted_year::bigint as interpreted_year from facts")
def curate_decade(spark, d):
    return longs(facts(spark, d).select("gbifid", "decade", "interpreted_month", "interpreted_year"), "decade", "interpreted_year")


@query(f"with {FACTS_SQL} select gbifid, cell_lat, cell_lon, cell_id, case when lat > 0 then 'north' when lat < 0 then 'south' when lat = 0 then 'equator' end as hemisphere from facts")
def curate_grid(spark, d):
    return longs(facts(spark, d).select("gbifid", "cell_lat", "cell_lon", "cell_id", S.hemisphere("lat").alias("hemisphere")), "cell_lat", "cell_lon")


@query(f"with {FACTS_SQL} select gbifid, basis, status, country, 'SPECIES' as taxon_rank from facts")
def curate_categoricals(spark, d):
    return facts(spark, d).select("gbifid", "basis", "status", "country", "taxon_rank")


@query(f"with {FACTS_SQL} select gbifid, array_to_string(issues, ',') as flags, n_issues::bigint as n_issues, n_geo_issues::bigint as n_geo_issues from facts")
def issues_normalised(spark, d):
    return longs(facts(spark, d).select("gbifid", F.array_join("issues", ",").alias("flags"), "n_issues", "n_geo_issues"), "n_issues", "n_geo_issues")


@query(f"with {FACTS_SQL} select n_issues::bigint as n_issues, count(*) as records from facts group by 1")
def issue_counts(spark, d):
    return longs(facts(spark, d).groupBy("n_issues").agg(n()), "n_issues")


@query("select o_orderstatus, count(*) as records from orders where o_totalprice >= 1000 and o_totalprice < 400000 and o_orderpriority <> '1-URGENT' and o_orderstatus = 'O' and o_orderdate > '1995-06-30' group by 1")
def filter_comparisons(spark, d):
    o = table(spark, d, "orders")
    return o.where((o.o_totalprice >= 1000) & (o.o_totalprice < 400000) & (o.o_orderpriority != "1-URGENT") & (o.o_orderstatus == "O") & (o.o_orderdate > "1995-06-30")).groupBy("o_orderstatus").agg(n())


@query(f"""with {FACTS_SQL} select count(*) filter (where basis <> 'HUMAN_OBSERVATION') as plain, count(*) filter (where basis is distinct from 'HUMAN_OBSERVATION') as complement,
  count(*) filter (where basis is null) as nulls, count(*) filter (where basis is not null) as known from facts""")
def filter_null_semantics(spark, d):
    b = F.col("basis")
    return facts(spark, d).agg(
        F.count_if(b != "HUMAN_OBSERVATION").alias("plain"),
        F.count_if(~b.eqNullSafe("HUMAN_OBSERVATION")).alias("complement"),
        F.count_if(b.isNull()).alias("nulls"),
        F.count_if(b.isNotNull()).alias("known"),
    )


@query(f"with {FACTS_SQL} select decade::bigint as decade, count(*) as records from facts where decade >= 1990 and usable_for_mapping group by 1")
def filter_partition(spark, d):
    return longs(facts(spark, d).where((F.col("decade") >= 1990) & F.col("usable_for_mapping")).groupBy("decade").agg(n()), "decade")


@query("select l_returnflag, count(*) as records from lineitem where l_quantity between 5 and 30 and not (l_discount > 0.05 or l_tax = 0) group by 1")
def filter_between_not(spark, d):
    li = table(spark, d, "lineitem")
    return li.where(li.l_quantity.between(5, 30) & ~((li.l_discount > 0.05) | (li.l_tax == 0))).groupBy("l_returnflag").agg(n())


@query("select c_mktsegment, count(*) as records from customer where c_acctbal > 0 and c_mktsegment in ('BUILDING', 'MACHINERY') or c_custkey % 10 = 0 group by 1")
def filter_string_expr(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 0 and c_mktsegment in ('BUILDING', 'MACHINERY') or c_custkey % 10 = 0").groupBy("c_mktsegment").agg(n())


@query("select cast(o_orderkey as varchar) as o_orderkey, cast(o_custkey as varchar) as o_custkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as o_orderdate from orders")
def cast_all_string(spark, d):
    from ..sources.tables import as_strings

    return as_strings(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate")))


@query("select page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) as host, regexp_replace(url, '[?#].*$', '') as bare, upper(substr(url, 1, 5)) as scheme from pages")
def regex_host(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.regexp_replace("url", r"[?#].*$", "").alias("bare"), F.upper(F.substring("url", 1, 5)).alias("scheme"))


@query(f"with {DIM_SQL} select datasetkey, license, dataset_type, dataset_year::bigint as dataset_year, publisher_key, publisher_country from dim")
def license_class(spark, d):
    return longs(publishers(spark, d).select("datasetkey", "license", "dataset_type", "dataset_year", "publisher_key", "publisher_country"), "dataset_year")


@query("select strftime(ts, '%Y-%m') as month, year(ts)::bigint as year, count(*) as records from events group by 1, 2")
def ts_month(spark, d):
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month"), long(F.year("ts")).alias("year")).agg(n())


@query("select l_orderkey, l_linenumber::bigint as l_linenumber, (floor(l_extendedprice / 100))::bigint as hundreds, round(l_extendedprice * (1 - l_discount), 6) as net, pow(l_quantity, 2) as square, (l_orderkey % 16)::bigint as salt from lineitem")
def math_functions(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", long("l_linenumber").alias("l_linenumber"), long(F.floor(li.l_extendedprice / 100)).alias("hundreds"), r6(li.l_extendedprice * (1 - li.l_discount)).alias("net"), F.pow("l_quantity", F.lit(2)).alias("square"), F.pmod("l_orderkey", F.lit(16)).alias("salt"))


# --- Joins -----------------------------------------------------------------------------------------------------------


@query(f"with {ENRICHED_SQL} select gbifid, datasetkey, publisher_key, publisher_title, publisher_country, license from enriched")
def enrich_left(spark, d):
    return enriched(spark, d).select("gbifid", "datasetkey", "publisher_key", "publisher_title", "publisher_country", "license")


@query(f"with {ENRICHED_SQL} select count(*) as records, count(*) filter (where publisher_key = 'UNREGISTERED') as unmatched from enriched")
def enrich_unmatched(spark, d):
    return joins.unmatched(facts(spark, d), publishers(spark, d), "datasetkey")


@query("""with a as (select case when l_suppkey % 4 = 0 then null else l_suppkey end as k from lineitem)
  select (select count(*) from a join supplier on k = s_suppkey) as inner_rows, (select count(*) from a left join supplier on k = s_suppkey) as left_rows, (select count(*) from a where k is null) as null_keys""")
def null_key_inner_vs_left(spark, d):
    a = table(spark, d, "lineitem").select(F.when(F.col("l_suppkey") % 4 != 0, F.col("l_suppkey")).alias("k"))
    # One left join tells all three: a row with a null key has no partner.
    j = a.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("s")), F.col("k") == F.col("s"), "left")
    return j.agg(F.count("s").alias("inner_rows"), F.count(F.lit(1)).alias("left_rows"), F.count_if(F.col("k").isNull()).alias("null_keys"))


_JOIN_SQL = "select s_name, count(*) as records, round(sum(l_extendedprice), 2) as price from lineitem join supplier on l_suppkey = s_suppkey group by 1"


def _supplier_totals(spark, d, mode):
    s = joins.hinted(table(spark, d, "supplier").select("s_suppkey", "s_name"), mode)
    j = table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy("s_name").agg(n(), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query(_JOIN_SQL)
def join_inner(spark, d):
    return _supplier_totals(spark, d, "auto")


@query(_JOIN_SQL)
def join_broadcast(spark, d):
    return _supplier_totals(spark, d, "broadcast")


@query(_JOIN_SQL)
def join_sortmerge(spark, d):
    return _supplier_totals(spark, d, "sortmerge")


@query("select c_custkey, c_mktsegment from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 100000)")
def join_semi(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 100000")
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return c.join(big, c["c_custkey"] == big["o_custkey"], "left_semi")


@query("select c_custkey, c_mktsegment from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def join_anti(spark, d):
    o, c = table(spark, d, "orders").where("o_totalprice > 400000"), table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti")


@query("select l_orderkey, l_linenumber::bigint as l_linenumber, l_quantity - avg(l_quantity) over (partition by l_suppkey) as gap, count(*) over (partition by l_suppkey) as group_rows from lineitem")
def join_self_summary(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    j = joins.with_group_aggregate(li, "l_suppkey", F.avg("l_quantity").alias("m"), F.count(F.lit(1)).alias("group_rows"))
    return j.select("l_orderkey", long("l_linenumber").alias("l_linenumber"), (F.col("l_quantity") - F.col("m")).alias("gap"), "group_rows")


#: A hot key: two thirds of the rows have supplier 1.
_HOT = "case when l_orderkey % 3 = 0 then l_suppkey else 1 end"
_HOT_SQL = f"select s_name, count(*) as records from (select {_HOT} as k from lineitem) join supplier on k = s_suppkey group by 1"


@query(_HOT_SQL)
def join_salted_hash(spark, d):
    li = table(spark, d, "lineitem").selectExpr(f"{_HOT} as k", "l_orderkey * 10 + l_linenumber as id")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    return joins.salted_join(li, s, "k", spread="id").groupBy("s_name").agg(n())


@query(_HOT_SQL)
def join_salted_string(spark, d):
    """The salt in the key itself: "key#salt"."""
    salts = 16
    li = table(spark, d, "lineitem").selectExpr(f"concat_ws('#', {_HOT}, pmod(l_orderkey * 10 + l_linenumber, {salts})) as k")
    s = flags.replicated(table(spark, d, "supplier").select("s_suppkey", "s_name"), salts, "salt").select(F.concat_ws("#", "s_suppkey", "salt").alias("k"), "s_name")
    return li.join(s, "k").groupBy("s_name").agg(n())


@query("select s_suppkey, s_name, n_name, r_name from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def dim_two_level_join(spark, d):
    s, na, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.join(na, s.s_nationkey == na.n_nationkey, "left").join(r, na.n_regionkey == r.r_regionkey, "left").select("s_suppkey", "s_name", "n_name", "r_name")


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'A')")
def antijoin_pending(spark, d):
    done = table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.pending(table(spark, d, "orders").select("o_orderkey"), done, "o_orderkey")


@query("select 'b0' as ingest_batch, o_orderkey, o_orderstatus, null::varchar as o_orderpriority from orders where o_orderkey % 2 = 0 union all select 'b1', o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderkey % 2 = 1")
def batch_union(spark, d):
    o = table(spark, d, "orders")
    a = o.where("o_orderkey % 2 = 0").select(F.lit("b0").alias("ingest_batch"), "o_orderkey", "o_orderstatus")
    b = o.where("o_orderkey % 2 = 1").select(F.lit("b1").alias("ingest_batch"), "o_orderkey", "o_orderpriority", "o_orderstatus")
    return joins.merge_caches(a, b)


# --- Aggregations ----------------------------------------------------------------------------------------------------


@query(f"""with {ENRICHED_SQL} select {MEASURES}, avg(cast(usable_for_mapping and uncertainty_known as int)) as usable_strict, avg(cast(n_issues > 0 as int)) as any_flag,
  avg(cast(n_geo_issues > 0 as int)) as geo_flag, count(distinct specieskey) as species, count(distinct cell_id) as cells, count(distinct publisher_key) as publishers from enriched""")
def headline(spark, d):
    return A.headline(enriched(spark, d), approximate=False)


@query()
def headline_hll(spark, d):
    return A.headline(enriched(spark, d))


def _breakdown(name: str, *keys: str):
    listed = ", ".join(f"{k}::bigint as {k}" if k == "decade" else k for k in keys)

    def run(spark, d):
        df = A.breakdown((enriched if "publisher_country" in keys else facts)(spark, d), *keys)  # the dimension is joined where it is read
        return longs(df, "decade") if "decade" in keys else df

    run.__name__ = name
    query(f"with {ENRICHED_SQL} select {listed}, {MEASURES} from enriched group by all")(run)


for _name, _keys in (("by_decade", ["decade"]), ("by_country", ["country"]), ("by_basis", ["basis"]), ("by_publisher_country", ["publisher_country"]), ("by_decade_country", ["decade", "country"])):
    _breakdown(_name, *_keys)


@query(f"""with {ENRICHED_SQL} select 'by_basis' as breakdown, null::bigint as decade, basis, {MEASURES} from enriched group by basis
  union all select 'by_decade', decade::bigint, null, {MEASURES} from enriched group by decade""")
def breakdowns_one_scan(spark, d):
    found = A.breakdowns(facts(spark, d), {"by_basis": ["basis"], "by_decade": ["decade"]})
    parts = [df.withColumn("breakdown", F.lit(name)) for name, df in found.items()]
    return longs(joins.merge_caches(*parts), "decade").select("breakdown", "decade", "basis", "records", "usable", "mean_flags")


@query(f"with {ENRICHED_SQL} select publisher_key, publisher_title, publisher_country, {MEASURES}, count(distinct datasetkey) as datasets from enriched group by 1, 2, 3")
def by_publisher(spark, d):
    return A.by_publisher(enriched(spark, d), approximate=False)


@query()
def by_publisher_hll(spark, d):
    return A.by_publisher(enriched(spark, d))


@query(f"with {ENRICHED_SQL} select datasetkey, {MEASURES} from enriched group by 1 having count(*) >= {LEAST_RECORDS}")
def by_dataset_having(spark, d):
    return A.breakdown(facts(spark, d), "datasetkey").where(F.col("records") >= LEAST_RECORDS)


@query("select count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers, count(distinct l_shipdate) as days from lineitem")
def multi_distinct(spark, d):
    return table(spark, d, "lineitem").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_shipdate").alias("days"))


_PROFILE = ["species", "country", "basis", "status", "uncertainty_m", "cell_id"]


@query(f"with {FACTS_SQL} " + " union all ".join(f"select '{c}' as column_name, count({c}) as non_null, 1 - count({c}) / count(*) as null_share from facts" for c in _PROFILE))
def null_profile(spark, d):
    return A.null_profile(facts(spark, d).select(*_PROFILE))


@query(f"with {FACTS_SQL} " + " union all ".join(f"select '{c}' as column_name, count(distinct {c}) as n_distinct, count(distinct {c}) / count(*) as per_row from facts" for c in _PROFILE))
def cardinality_profile(spark, d):
    return A.cardinality_profile(facts(spark, d).select(*_PROFILE), approximate=False)


@query()
def cardinality_profile_hll(spark, d):
    return A.cardinality_profile(facts(spark, d).select(*_PROFILE))


@query("select user_id, count(*) as records from events group by 1 order by records desc, user_id limit 10")
def top_values(spark, d):
    return A.top_values(table(spark, d, "events"), "user_id", 10)


@query("select strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_ts, min(value) as least, max(value) as most from events")
def minmax_ts_string(spark, d):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return table(spark, d, "events").agg(text(F.min("ts")).alias("first_ts"), text(F.max("ts")).alias("last_ts"), F.min("value").alias("least"), F.max("value").alias("most"))


@query(f"with {FACTS_SQL} select count(*) filter (where not coord_valid) as bad_points, count(*) filter (where n_issues > 1) as many_flags, count(case when uncertainty_m > 10000 then 1 end) as vague, count(*) filter (where lat = 0 and lon = 0) as null_island from facts")
def conditional_counts(spark, d):
    return facts(spark, d).agg(F.count_if(~F.col("coord_valid")).alias("bad_points"), F.count_if(F.col("n_issues") > 1).alias("many_flags"), F.count(F.when(F.col("uncertainty_m") > 10000, 1)).alias("vague"), F.count_if("null_island").alias("null_island"))


@query("select quantile_disc(l_quantity, 0.5) as p50, quantile_disc(l_quantity, 0.9) as p90 from lineitem")
def percentiles(spark, d):
    p = lambda q: F.percentile_approx("l_quantity", q, 1_000_000)
    return table(spark, d, "lineitem").agg(p(0.5).alias("p50"), p(0.9).alias("p90"))


@query("select l_suppkey, max_by(l_partkey, struct_pack(a := l_extendedprice, b := l_orderkey, c := l_linenumber)) as dearest_part, round(sum(l_quantity), 2) as quantity, round(avg(l_discount), 6) as discount from lineitem group by 1")
def argmax(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.max_by("l_partkey", F.struct("l_extendedprice", "l_orderkey", "l_linenumber")).alias("dearest_part"), F.round(F.sum("l_quantity"), 2).alias("quantity"), r6(F.avg("l_discount")).alias("discount"))


@query(f"with {FACTS_SQL} select decade::bigint as decade, count(*) as records from facts where decade >= 1900 group by 1")
def decade_histogram(spark, d):
    return longs(facts(spark, d).where("decade >= 1900").groupBy("decade").agg(n()).orderBy("decade"), "decade")


_GATES = ["has_species", "has_coords", "coord_valid", "has_geo_issue", "year_known", "is_present", "uncertainty_known", "uncertainty_ok", "usable_for_mapping"]


@query(f"with {FACTS_SQL} " + " union all ".join(f"select '{g}' as gate, avg(cast({'lat is not null and lon is not null' if g == 'has_coords' else g} as int)) as share from facts" for g in _GATES))
def gate_shares(spark, d):
    from ..cli import gate_shares as shares

    return shares(facts(spark, d), _GATES)


@query(f"with {FACTS_SQL} select decade::bigint as decade, count(*) as records, avg(cast(usable_for_mapping as int)) as usable, avg(cast(usable_for_mapping and uncertainty_known as int)) as usable_strict from facts group by 1")
def share_by_decade(spark, d):
    from ..cli import usable_by_decade

    return longs(usable_by_decade(facts(spark, d)), "decade")


@query(f"""with {DIM_SQL} select 'license' as kind, license as name, count(*) as datasets from dim group by license union all select 'type', dataset_type, count(*) from dim group by dataset_type
  union all select 'publisher', publisher_key, count(*) from dim group by publisher_key, publisher_title""")
def dimension_report(spark, d):
    found = report(publishers(spark, d))
    pick = lambda kind, name, key: found[name].select(F.lit(kind).alias("kind"), F.col(key).alias("name"), "datasets")
    return joins.merge_caches(pick("license", "by_license", "license"), pick("type", "by_type", "dataset_type"), pick("publisher", "by_publisher", "publisher_key"))


@query(f"with {DIM_SQL} select count(*) as datasets, count(distinct publisher_key) as publishers, count(distinct publisher_country) as countries from dim")
def dimension_totals(spark, d):
    return report(publishers(spark, d))["totals"]


@query(f"with {FACTS_SQL} select decade::bigint as decade, country, basis, grouping(decade, country, basis)::bigint as set_id, count(*) as records from facts group by cube(decade, country, basis)")
def cube3(spark, d):
    return longs(facts(spark, d).cube("decade", "country", "basis").agg(long(F.grouping_id()).alias("set_id"), n()), "decade")


@query(f"with {FACTS_SQL} select decade::bigint as decade, country, basis, grouping(decade, country, basis)::bigint as set_id, count(*) as records from facts group by grouping sets ((decade), (country), (basis))")
def grouping_sets(spark, d):
    c = [F.col(x) for x in ("decade", "country", "basis")]
    return longs(facts(spark, d).groupingSets([[c[0]], [c[1]], [c[2]]], *c).agg(long(F.grouping_id()).alias("set_id"), n()), "decade")


@query(f"""with {FACTS_SQL} select decade::bigint as decade, nullif(count(*) filter (where basis = 'HUMAN_OBSERVATION'), 0) as human, nullif(count(*) filter (where basis = 'MACHINE_OBSERVATION'), 0) as machine from facts group by 1""")
def pivot_basis(spark, d):
    p = facts(spark, d).groupBy("decade").pivot("basis", ["HUMAN_OBSERVATION", "MACHINE_OBSERVATION"]).agg(F.count(F.lit(1)))
    return longs(p.toDF("decade", "human", "machine"), "decade")


def _variance_sql(group: str, keys: str) -> str:
    return f"""with {ENRICHED_SQL},
one as (select {group} as g, {keys}, avg(n_issues) as x from enriched group by all having count(*) >= 20),
s as (select x, avg(x) over (partition by g) as m, count(*) over (partition by g) as k from one),
kept as (select x, m, avg(x) over () as grand from s where k >= 3)
select count(*) as datasets, round(coalesce(avg(x), 0), 6) as grand_mean, round(coalesce(avg(pow(x - m, 2)), 0), 6) as within, round(coalesce(avg(pow(m - grand, 2)), 0), 6) as between,
  round(coalesce(avg(pow(m - grand, 2)) / greatest(avg(pow(x - m, 2)) + avg(pow(m - grand, 2)), 1e-12), 0), 4) as between_share from kept"""


def _variance(e: DataFrame, group: str, *keys: str) -> DataFrame:
    one = e.groupBy(group, *keys).agg(n(), F.avg("n_issues").alias("x")).where("records >= 20")
    v = rounded(A.variance_decomposition(one, group, "x"), "grand_mean", "within", "between")
    return v.withColumn("between_share", F.round("between_share", 4))


@query(_variance_sql("publisher_key", "datasetkey"))
def variance_publisher(spark, d):
    return _variance(enriched(spark, d), "publisher_key", "datasetkey")


@query(_variance_sql("interpreted_year", "datasetkey"))
def variance_year_control(spark, d):
    return _variance(facts(spark, d), "interpreted_year", "datasetkey")


@query("select records, count(*) as suppliers from (select l_suppkey, count(*) as records from lineitem group by 1) group by 1")
def group_count_of_groups(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(n()).groupBy("records").agg(F.count(F.lit(1)).alias("suppliers"))


@query(f"""with c as (select {_HOT} as k, count(*) as records from lineitem group by 1), t as (select sum(records) as a, count(*) as b from c), top as (select * from c order by records desc, k limit 10)
  select k, records, records / a as share, records * b / a as times_mean, sum(records) over () / a as top_share from top, t""")
def skew_report(spark, d):
    li = table(spark, d, "lineitem").selectExpr(f"{_HOT} as k")
    return A.skew_report(li, "k")


# --- Windows ---------------------------------------------------------------------------------------------------------

_RANKED = f"""with {ENRICHED_SQL}, one as (select publisher_key, datasetkey, count(*) as records, avg(n_issues) as mean_flags from enriched group by 1, 2 having count(*) >= {LEAST_RECORDS})
select publisher_key, datasetkey, records, sum(records) over p::bigint as pub_records, round(avg(mean_flags) over p, 6) as pub_mean_flags, count(*) over p as pub_datasets,
  row_number() over (partition by publisher_key order by records desc, datasetkey) as rank_in_pub, round(mean_flags - avg(mean_flags) over p, 6) as flag_gap from one window p as (partition by publisher_key)"""


def _ranked(spark, d):
    df = A.by_dataset(enriched(spark, d), LEAST_RECORDS)
    return rounded(longs(df, "rank_in_pub"), "pub_mean_flags", "flag_gap").select("publisher_key", "datasetkey", "records", "pub_records", "pub_mean_flags", "pub_datasets", "rank_in_pub", "flag_gap")


@query(_RANKED.replace("sum(records) over p::bigint", "(sum(records) over p)::bigint"))
def win_partition_stats(spark, d):
    return _ranked(spark, d)


@query(f"select publisher_key, datasetkey, records, rank_in_pub from ({_RANKED.replace('sum(records) over p::bigint', '(sum(records) over p)::bigint')}) where rank_in_pub <= 3 and pub_datasets >= 5")
def win_topn(spark, d):
    return _ranked(spark, d).where("rank_in_pub <= 3 and pub_datasets >= 5").select("publisher_key", "datasetkey", "records", "rank_in_pub")


_TREND = """with y as (select l_returnflag as basis, year(l_shipdate)::bigint as year, count(*) as records from lineitem group by 1, 2)
select basis, year, records, lag(records) over w as previous, round((records - lag(records) over w) * 100.0::double / lag(records) over w, 1) as change_pct,
  avg(records) over (partition by basis order by year rows between 4 preceding and current row) as rolling_mean,
  (sum(records) over (partition by basis order by year rows unbounded preceding))::bigint as running_total, first(records) over (partition by basis order by year rows unbounded preceding) as first_value
from y window w as (partition by basis order by year)"""


def _trend(spark, d):
    y = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("basis"), long(F.year("l_shipdate")).alias("year")).agg(n())
    return windows.trend(y, "basis", "year", "records")


@query(f"select basis, year, records, previous, change_pct from ({_TREND})")
def win_lag_yoy(spark, d):
    return _trend(spark, d).select("basis", "year", "records", "previous", "change_pct")


@query(f"select basis, year, records, rolling_mean, running_total, first_value from ({_TREND})")
def win_rolling_cumulative(spark, d):
    return _trend(spark, d).select("basis", "year", "records", "rolling_mean", "running_total", "first_value")


@query("with c as (select l_suppkey, count(*) as records from lineitem group by 1) select l_suppkey, records, row_number() over (order by records desc, l_suppkey) as row from c")
def win_global_rownum(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_suppkey").agg(n())
    return longs(windows.global_rows(c, [F.desc("records"), "l_suppkey"]), "row")


@query("select * from (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 2")
def win_topn_rows(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return longs(windows.top_n(o, "o_custkey", [F.desc("o_totalprice"), "o_orderkey"], 2), "rank")


# --- Flags -----------------------------------------------------------------------------------------------------------


@query(f"with {FACTS_SQL} select flag, count(*) as records from (select unnest(issues) as flag from facts) group by 1")
def flags_overall(spark, d):
    return flags.flag_counts(facts(spark, d))


@query(f"with {ENRICHED_SQL} select publisher_key, flag, count(*) as records from (select publisher_key, unnest(issues) as flag from enriched) group by 1, 2")
def flags_publisher(spark, d):
    return flags.flag_counts(enriched(spark, d), "publisher_key")


@query(f"with {FACTS_SQL} select decade::bigint as decade, flag, count(*) as records from (select decade, unnest(issues) as flag from facts) group by 1, 2")
def flags_decade(spark, d):
    return longs(flags.flag_counts(facts(spark, d), "decade"), "decade")


@query(f"with {FACTS_SQL} select decade::bigint as decade, country, flag, count(*) as records from (select decade, country, unnest(issues) as flag from facts) group by 1, 2, 3")
def flags_three_keys(spark, d):
    return longs(flags.flag_counts(facts(spark, d), "decade", "country"), "decade")


@query(f"with {FACTS_SQL} select count(*) as rows_before, sum(n_issues)::bigint as rows_after, avg(n_issues) as factor from facts")
def flag_explosion(spark, d):
    return flags.explosion(facts(spark, d))


@query(f"with {FACTS_SQL} select flag as array_element, count(*) as records from (select unnest(issues) as flag from facts) group by 1")
def explode_struct(spark, d):
    return flags.struct_field(demo.raw_records(spark, d), "issue", "array_element")


@query("select r_name, copy::bigint as copy from region, range(4) t(copy)")
def replicate_rows(spark, d):
    return longs(flags.replicated(table(spark, d, "region").select("r_name"), 4), "copy")


# --- Sorts, limits, verification -------------------------------------------------------------------------------------


@query("with g as (select l_returnflag, count(*) as records from lineitem group by 1) select (select sum(records) from g)::bigint as summed, (select count(*) from lineitem) as counted, true as equal")
def verify_sum(spark, d):
    li = table(spark, d, "lineitem")
    one = li.groupBy("l_returnflag").agg(n()).agg(F.sum("records").alias("summed"))
    return one.crossJoin(li.agg(F.count(F.lit(1)).alias("counted"))).withColumn("equal", F.col("summed") == F.col("counted"))  # one row each


@query("select n_regionkey::bigint as n_regionkey, n_name from nation order by n_regionkey, n_name desc")
def sort_multi(spark, d):
    return table(spark, d, "nation").select(long("n_regionkey").alias("n_regionkey"), "n_name").orderBy("n_regionkey", F.desc("n_name"))


@query("select l_orderkey, l_linenumber::bigint as l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 20")
def topk(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", long("l_linenumber").alias("l_linenumber"), "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(20)


@query("select l_orderkey, l_linenumber::bigint as l_linenumber from lineitem where l_quantity > 49")
def sort_then_filter(spark, d):
    return table(spark, d, "lineitem").orderBy("l_orderkey").where("l_quantity > 49").select("l_orderkey", long("l_linenumber").alias("l_linenumber"))


@query("select distinct l_suppkey, l_returnflag from lineitem")
def distinct_keys(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", "l_returnflag").distinct()


# --- UDFs ------------------------------------------------------------------------------------------------------------

_UDF_SQL = "select l_orderkey, l_linenumber::bigint as l_linenumber, (coalesce(nullif(l_linenumber, 3), 0) - coalesce(l_orderkey % 5, 0))::bigint as gap from lineitem"


def _udf(spark, d, f):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("nullif(l_linenumber, 3)").alias("a"), F.expr("cast(l_orderkey % 5 as int)").alias("b"))
    return li.select("l_orderkey", long("l_linenumber").alias("l_linenumber"), long(f("a", "b")).alias("gap"))


@query(_UDF_SQL)
def udf_builtin(spark, d):
    return _udf(spark, d, udfs.difference)


@query(_UDF_SQL)
def udf_pandas(spark, d):
    return _udf(spark, d, udfs.difference_pandas)


@query(_UDF_SQL)
def udf_python(spark, d):
    return _udf(spark, d, udfs.difference_python)


# --- Engine-specific: rows only --------------------------------------------------------------------------------------


@query()
def rows_per_partition(spark, d):
    return A.rows_per_partition(table(spark, d, "lineitem").repartition(8, "l_suppkey"))


@query()
def hash_placement(spark, d):
    return A.hash_placement(table(spark, d, "lineitem"), "l_suppkey", 24)


@query()
def rowhash_checksum(spark, d):
    return A.checksum(table(spark, d, "lineitem"))


@query("select 'lineitem.parquet' as src_shard, count(*) as records from lineitem")
def file_lineage(spark, d):
    """A row a file; the supplied table is one."""
    from ..sources.tables import with_lineage

    return with_lineage(table(spark, d, "lineitem")).groupBy("src_shard").agg(n())


@query()
def limit_take(spark, d):
    """Any five rows."""
    return table(spark, d, "lineitem").limit(5)


@query()
def random_sample(spark, d):
    """Rows by a seeded random number: a sampling operator."""
    return table(spark, d, "lineitem").where(F.rand(7) < 0.01)


@query("select l_returnflag, count(*) as records from lineitem where l_shipdate >= '2001-06-01' group by 1")
def rowgroup_filter(spark, d):
    """A filter that reaches the scan's row group statistics."""
    return table(spark, d, "lineitem").where("l_shipdate >= '2001-06-01'").groupBy("l_returnflag").agg(n())
