"""The curated row: every quality rule is a column, no row is dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Limits of the gate.
UNCERTAINTY_OK_M, UNCERTAINTY_SANE_M = 10_000.0, 20_000_000.0

#: Flags that make a place unusable.
FATAL_GEO_FLAGS = [
    "ZERO_COORDINATE",
    "COORDINATE_INVALID",
    "COORDINATE_OUT_OF_RANGE",
    "COORDINATE_REPROJECTION_FAILED",
    "COUNTRY_COORDINATE_MISMATCH",
    "PRESUMED_SWAPPED_COORDINATE",
    "PRESUMED_NEGATED_LATITUDE",
    "PRESUMED_NEGATED_LONGITUDE",
]

#: The source's columns that are read, where they exist.
SOURCE_COLUMNS = """
gbifid datasetkey publishingorgkey institutioncode license
kingdom phylum class order family genus species specieskey taxonrank scientificname
countrycode decimallatitude decimallongitude coordinateuncertaintyinmeters
eventdate year month lastinterpreted
basisofrecord occurrencestatus individualcount issue
""".split()

#: Columns under their curated names: categories that are normalised, and plain renames.
_CATEGORIES = {"basisofrecord": "basis", "occurrencestatus": "status", "countrycode": "country", "taxonrank": "taxon_rank"}
_RENAMES = {"class": "taxon_class", "order": "taxon_order", "decimallatitude": "lat", "decimallongitude": "lon"}


def tolerant_select(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that df has."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{c}`") for c in columns if c in have])


def curate(raw: DataFrame) -> DataFrame:
    """Pure, narrow: rows in, the same rows out with the derived columns. An unknown status is not usable, never null."""
    df = tolerant_select(raw, SOURCE_COLUMNS)
    kind = dict(raw.dtypes)["issue"]
    unwrapped = F.transform("issue", lambda x: x["array_element"]) if "struct" in kind else F.col("issue")
    df = df.withColumn("issues", F.coalesce(F.array_sort(unwrapped.cast("array<string>")), F.array().cast("array<string>"))).drop("issue")
    df = df.withColumns({new: S.normalised(old) for old, new in _CATEGORIES.items() if old in df.columns}).drop(*_CATEGORIES)
    df = df.withColumnsRenamed({k: v for k, v in _RENAMES.items() if k in df.columns})
    stamp, uncertainty = F.col("lastinterpreted"), F.col("coordinateuncertaintyinmeters")
    fatal = F.array(*[F.lit(x) for x in FATAL_GEO_FLAGS])
    df = df.withColumns(
        {
            "n_issues": F.size("issues"),
            "n_geo_issues": F.size(F.array_intersect("issues", fatal)),
            "is_present": F.col("status") == "PRESENT",
            "year_known": S.plausible_year("year"),
            "decade": S.decade("year"),
            "interpreted_month": F.date_format(stamp, "yyyy-MM"),
            "interpreted_year": F.year(stamp),
            "has_coords": F.col("lat").isNotNull() & F.col("lon").isNotNull(),
            "null_island": (F.col("lat") == 0) & (F.col("lon") == 0),
            "coord_valid": S.valid_point("lat", "lon"),
            "uncertainty_m": F.when(uncertainty.between(0, UNCERTAINTY_SANE_M), uncertainty),
            "has_species": F.coalesce(F.trim("species") != "", F.lit(False)),
            "src_shard": F.regexp_extract(F.input_file_name(), r"[^/]*$", 0),
        }
    ).drop("coordinateuncertaintyinmeters")
    df = df.withColumns(
        {
            "has_geo_issue": F.col("n_geo_issues") > 0,
            "cell_lat": S.cell("lat", "coord_valid"),
            "cell_lon": S.cell("lon", "coord_valid"),
            "uncertainty_known": F.col("uncertainty_m").isNotNull(),
            "uncertainty_ok": F.coalesce(F.col("uncertainty_m") <= UNCERTAINTY_OK_M, F.lit(True)),
        }
    )
    usable = F.col("has_species") & F.col("coord_valid") & ~F.col("has_geo_issue") & F.col("year_known") & F.coalesce("is_present", F.lit(False)) & F.col("uncertainty_ok")
    return df.withColumns({"cell_id": S.cell_id("cell_lat", "cell_lon"), "usable_for_mapping": usable})
