"""The curated row, on hand-made rows that each meet one rule."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.plans import curate as C

ISSUE = T.ArrayType(T.StructType([T.StructField("array_element", T.StringType())]))
SCHEMA = T.StructType(
    [T.StructField("gbifid", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("datasetkey", "publishingorgkey", "species")]
    + [T.StructField("specieskey", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("class", "order", "countrycode")]
    + [T.StructField(c, T.DoubleType()) for c in ("decimallatitude", "decimallongitude", "coordinateuncertaintyinmeters")]
    + [T.StructField("year", T.IntegerType()), T.StructField("lastinterpreted", T.TimestampType())]
    + [T.StructField(c, T.StringType()) for c in ("basisofrecord", "occurrencestatus", "taxonrank")]
    + [T.StructField("issue", ISSUE)]
)
DAY = dt.datetime(2025, 3, 4, 5, 6)


def row(i, **changes):
    base = dict(gbifid=i, datasetkey="d", publishingorgkey="o", species="Lynx lynx", specieskey=1, countrycode="se", decimallatitude=59.5, decimallongitude=18.2, coordinateuncertaintyinmeters=30.0, year=2015, lastinterpreted=DAY, basisofrecord="human_observation", occurrencestatus="PRESENT", taxonrank="species", issue=[])
    base |= {"class": "Mammalia", "order": "Carnivora"} | changes
    if base["issue"] is not None:
        base["issue"] = [(x,) for x in base["issue"]]
    return tuple(base[f.name] for f in SCHEMA)


#: Each row is at a boundary of one rule, on one side of it or the other.
ROWS = [
    row(1, decimallatitude=89.99, year=1600, coordinateuncertaintyinmeters=10_000.0, issue=["CONTINENT_DERIVED_FROM_COORDINATES"]),
    row(2, decimallatitude=90.01, year=1599, coordinateuncertaintyinmeters=10_000.01),
    row(3, decimallatitude=90.0, decimallongitude=-180.0, coordinateuncertaintyinmeters=0.0, year=1999),
    row(4, decimallongitude=180.01, coordinateuncertaintyinmeters=20_000_000.0, year=2000, species=" "),
    row(5, decimallatitude=0.0, decimallongitude=0.0, coordinateuncertaintyinmeters=20_000_000.5, issue=["ZERO_COORDINATE", "PRESUMED_SWAPPED_COORDINATE", "AMBIGUOUS_NAME"]),
    row(6, occurrencestatus=None, species=None, countrycode="\t", year=None, coordinateuncertaintyinmeters=None, issue=None),
    row(7, decimallatitude=None, decimallongitude=None, occurrencestatus=" present "),
    row(8, decimallatitude=0.0, decimallongitude=0.001, issue=["B_FLAG", None, "A_FLAG"]),
    row(9, decimallatitude=-0.5, decimallongitude=-89.0, occurrencestatus="absent"),
    row(10, decimallatitude=None, coordinateuncertaintyinmeters=-0.01, year=-5),
]


@pytest.fixture(scope="module")
def rows(spark):
    return {r.gbifid: r for r in C.curate(spark.createDataFrame(ROWS, SCHEMA)).collect()}


def test_issues(rows):
    assert rows[1].issues == ["CONTINENT_DERIVED_FROM_COORDINATES"] and rows[1].n_geo_issues == 0 and rows[1].has_geo_issue is False
    assert rows[5].issues == ["AMBIGUOUS_NAME", "PRESUMED_SWAPPED_COORDINATE", "ZERO_COORDINATE"] and (rows[5].n_issues, rows[5].n_geo_issues) == (3, 2) and rows[5].has_geo_issue
    assert rows[6].issues == [] and rows[6].n_issues == 0
    assert rows[8].issues == ["A_FLAG", "B_FLAG", None] and rows[8].n_issues == 3


def test_categories(rows):
    assert (rows[1].basis, rows[1].country, rows[6].country) == ("HUMAN_OBSERVATION", "SE", "\t")  # spaces alone are trimmed
    assert (rows[1].taxon_class, rows[1].taxon_order, rows[1].taxon_rank) == ("Mammalia", "Carnivora", "SPECIES")
    assert [rows[i].is_present for i in (1, 6, 7, 9)] == [True, None, True, False]
    assert [rows[i].has_species for i in (1, 4, 6)] == [True, False, False]


def test_time(rows):
    assert [rows[i].decade for i in (1, 2, 3, 4, 6, 10)] == [1600, 0, 1990, 2000, 0, 0]
    assert [rows[i].year_known for i in (1, 2, 6, 10)] == [True, False, False, False]
    assert (rows[1].interpreted_month, rows[1].interpreted_year) == ("2025-03", 2025)


def test_space(rows):
    assert [rows[i].coord_valid for i in (1, 2, 3, 4, 5, 7, 8, 9, 10)] == [True, False, True, False, False, False, True, True, False]
    assert rows[5].null_island and not rows[8].null_island and [rows[i].has_coords for i in (2, 5, 7, 10)] == [True, True, False, False]
    assert (rows[9].cell_lat, rows[9].cell_lon, rows[9].cell_id) == (-1, -89, "-1_-89") and rows[8].cell_id == "0_0" and rows[3].cell_id == "90_-180"
    assert [rows[i].cell_id for i in (2, 4, 5, 7)] == [None] * 4


def test_uncertainty(rows):
    assert [rows[i].uncertainty_m for i in (1, 3, 4, 5, 6, 10)] == [10_000.0, 0.0, 20_000_000.0, None, None, None]
    assert [rows[i].uncertainty_known for i in (3, 5, 6, 10)] == [True, False, False, False]
    assert [rows[i].uncertainty_ok for i in (1, 2, 3, 4, 5, 6, 10)] == [True, False, True, False, True, True, True]


def test_gate(rows):
    assert {i for i, r in rows.items() if r.usable_for_mapping} == {1, 3, 8}


def test_invariants(rows):
    assert len(rows) == len(ROWS)
    assert all(r.decade is not None and r.usable_for_mapping is not None for r in rows.values())


def test_absent_columns_are_tolerated(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).drop("taxonrank", "class", "publishingorgkey")
    out = C.curate(df)
    assert "taxon_class" not in out.columns and out.count() == len(ROWS)


def test_curate_is_narrow(spark):
    from fieldmark.measure.plans import exchange_count

    assert exchange_count(C.curate(spark.createDataFrame(ROWS, SCHEMA))) == 0


def test_license_classes(spark):
    from fieldmark.functions.scalars import license_class

    cases = {
        "http://creativecommons.org/licenses/by/4.0/legalcode": "CC_BY_4_0",
        "http://creativecommons.org/licenses/by-nc/4.0/legalcode": "CC_BY-NC_4_0",
        "http://creativecommons.org/publicdomain/zero/1.0/legalcode": "CC0_1_0",
        "https://creativecommons.org/publicdomain/mark/1.0/": "PDM_1_0",
        None: "UNSPECIFIED",
        "": "UNSPECIFIED",
        "  ": "UNSPECIFIED",
        "http://example.com/some-bespoke-licence": "OTHER",
    }
    df = spark.createDataFrame([(u, w) for u, w in cases.items()], "url string, want string")
    assert df.withColumn("got", license_class("url")).where(~F.col("got").eqNullSafe(F.col("want"))).count() == 0


def test_malformed_dates_are_null(spark):
    from fieldmark.functions.scalars import year_of_text

    df = spark.createDataFrame([("2007-03-04T05:06:07.000+00:00",), ("unknown",), (None,)], "t string")
    assert [r[0] for r in df.select(year_of_text("t")).collect()] == [2007, None, None]
