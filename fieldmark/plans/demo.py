"""The supplied tables in the shape of the engine's data: raw records from lineitem, the dimension from supplier, nation and region.

The tables have no nulls; nulls, blanks, typos and flags are put in by rules of the row, so that every rule of the gate is met.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import enrich
from .curate import curate
from .dimension import derive


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FLAGS = {
    "COORDINATE_OUT_OF_RANGE": "l_quantity > 47",
    "RECORDED_DATE_INVALID": "l_tax = 0",
    "TAXON_MATCH_NONE": "l_discount >= 0.08",
    "ZERO_COORDINATE": "l_quantity = 25",
}


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    issue = ", ".join(f"if({when}, named_struct('array_element', '{name}'), null)" for name, when in reversed(_FLAGS.items()))
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber as gbifid",
        "cast(l_suppkey as string) as datasetkey",
        "case when l_linenumber = 7 then '  ' when l_returnflag = 'R' and l_linenumber = 1 then null else concat('sp ', l_partkey % 500) end as species",
        "cast(l_partkey % 500 as int) as specieskey",
        "array('us', ' se', 'br ', 'de', '')[cast(l_suppkey % 5 as int)] as countrycode",
        "l_quantity * 4 - 100 as decimallatitude",
        "l_extendedprice / 300 - 200 as decimallongitude",
        "case when l_tax = 0 then null else l_discount * 200000 end as coordinateuncertaintyinmeters",
        "case when l_linenumber = 4 and l_quantity < 5 then null when l_linenumber = 5 and l_quantity < 5 then 12 else year(l_shipdate) end as year",
        "l_shipdate as lastinterpreted",
        "case l_returnflag when 'A' then 'human_observation' when 'N' then ' Machine_Observation ' else '' end as basisofrecord",
        "case l_linenumber when 2 then null when 3 then 'absent' else ' present ' end as occurrencestatus",
        "'species' as taxonrank",
        f"if(l_linenumber = 6, null, array_compact(array({issue}))) as issue",
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate(raw_records(spark, sf_dir))


def publishers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension; every tenth dataset is not in the registry."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.where("s_suppkey % 10 <> 3").join(n, s["s_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left")
    raw = joined.selectExpr(
        "cast(s_suppkey as string) as datasetkey",
        "s_name as dataset_title",
        "if(s_suppkey % 4 = 0, '', ' occurrence') as dataset_type",
        "case s_suppkey % 6 when 0 then null when 1 then 'http://c.org/licenses/by/4.0/legalcode' when 2 then 'http://c.org/licenses/by-nc/4.0/legalcode' when 4 then 'http://c.org/publicdomain/zero/1.0/legalcode' when 5 then 'http://c.org/publicdomain/mark/1.0/' else 'http://c.org/own' end as license_url",
        "if(s_suppkey % 11 = 0, null, n_name) as publisher_key",
        "cast(null as string) as installation_key",
        "if(s_suppkey % 9 = 0, 'unknown', concat(2000 + s_suppkey % 20, '-03-04T05:06:07.000+00:00')) as dataset_created",
        "cast(null as string) as dataset_modified",
        "n_name as publisher_title",
        "concat(' ', lower(r_name)) as publisher_country",
    )
    return derive(raw)


def enriched(spark: SparkSession, sf_dir: str, mode: str = "auto") -> DataFrame:
    return enrich(facts(spark, sf_dir), publishers(spark, sf_dir), mode)


# --- The same in SQL, for the oracle ---------------------------------------------------------------------------------

RAW_SQL = """raw as (
  select l_orderkey * 10 + l_linenumber as gbifid, cast(l_suppkey as varchar) as datasetkey,
    case when l_linenumber = 7 then '  ' when l_returnflag = 'R' and l_linenumber = 1 then null else 'sp ' || (l_partkey % 500) end as species,
    l_partkey % 500 as specieskey,
    ['us', ' se', 'br ', 'de', ''][(l_suppkey % 5) + 1] as countrycode,
    l_quantity * 4 - 100 as lat, l_extendedprice / 300 - 200 as lon,
    case when l_tax = 0 then null else l_discount * 200000 end as unc,
    case when l_linenumber = 4 and l_quantity < 5 then null when l_linenumber = 5 and l_quantity < 5 then 12 else year(l_shipdate) end as year,
    l_shipdate as lastinterpreted,
    case l_returnflag when 'A' then 'human_observation' when 'N' then ' Machine_Observation ' else '' end as basisofrecord,
    case l_linenumber when 2 then null when 3 then 'absent' else ' present ' end as occurrencestatus,
    case when l_linenumber = 6 then [] else list_filter([case when l_quantity > 47 then 'COORDINATE_OUT_OF_RANGE' end, case when l_tax = 0 then 'RECORDED_DATE_INVALID' end, case when l_discount >= 0.08 then 'TAXON_MATCH_NONE' end, case when l_quantity = 25 then 'ZERO_COORDINATE' end], lambda x : x is not null) end as issues
  from lineitem)"""

FACTS_SQL = f"""{RAW_SQL},
gates as (
  select *, nullif(upper(trim(basisofrecord)), '') as basis, nullif(upper(trim(occurrencestatus)), '') as status, nullif(upper(trim(countrycode)), '') as country,
    len(issues) as n_issues,
    len(list_filter(issues, lambda x : x in ('ZERO_COORDINATE', 'COORDINATE_OUT_OF_RANGE'))) as n_geo_issues,
    coalesce(year >= 1600, false) as year_known,
    case when year >= 1600 then (year // 10) * 10 else 0 end as decade,
    lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0) as coord_valid,
    case when unc between 0 and 20000000 then unc end as uncertainty_m,
    coalesce(trim(species) <> '', false) as has_species
  from raw),
facts as (
  select *, n_geo_issues > 0 as has_geo_issue, status = 'PRESENT' as is_present,
    case when coord_valid then cast(floor(lat) as bigint) end as cell_lat, case when coord_valid then cast(floor(lon) as bigint) end as cell_lon,
    case when coord_valid then cast(floor(lat) as bigint) || '_' || cast(floor(lon) as bigint) end as cell_id,
    uncertainty_m is not null as uncertainty_known, coalesce(uncertainty_m <= 10000, true) as uncertainty_ok,
    has_species and coord_valid and n_geo_issues = 0 and year_known and coalesce(status = 'PRESENT', false) and coalesce(uncertainty_m <= 10000, true) as usable_for_mapping,
    strftime(lastinterpreted, '%Y-%m') as interpreted_month, year(lastinterpreted) as interpreted_year
  from gates)"""

DIM_SQL = """dim as (
  select cast(s_suppkey as varchar) as datasetkey, s_name as dataset_title,
    case when s_suppkey % 4 = 0 then null else 'OCCURRENCE' end as dataset_type,
    case s_suppkey % 6 when 0 then 'UNSPECIFIED' when 1 then 'CC_BY_4_0' when 2 then 'CC_BY-NC_4_0' when 4 then 'CC0_1_0' when 5 then 'PDM_1_0' else 'OTHER' end as license,
    case when s_suppkey % 11 = 0 then 'UNKNOWN' else n_name end as publisher_key, n_name as publisher_title, upper(r_name) as publisher_country,
    case when s_suppkey % 9 = 0 then null else 2000 + s_suppkey % 20 end as dataset_year
  from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey
  where s_suppkey % 10 <> 3)"""

ENRICHED_SQL = f"""{FACTS_SQL}, {DIM_SQL},
enriched as (
  select f.*, coalesce(d.publisher_key, 'UNREGISTERED') as publisher_key, coalesce(d.publisher_title, '<not in registry>') as publisher_title, d.publisher_country, d.license
  from facts f left join dim d on f.datasetkey = d.datasetkey)"""
