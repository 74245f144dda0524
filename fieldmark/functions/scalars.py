"""Scalar building blocks: column in, column out, all of them built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the first year that is taken to be real.
FIRST_YEAR = 1600


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalised(c: Column | str) -> Column:
    """Trimmed and upper-cased; blank is null."""
    text = F.upper(F.trim(_col(c)))
    return F.when(text != "", text)


def plausible_year(c: Column | str) -> Column:
    """Never null."""
    return F.coalesce(_col(c) >= FIRST_YEAR, F.lit(False))


def decade(c: Column | str) -> Column:
    """The decade of a plausible year, else 0; never null, so it can be a partition column."""
    year = _col(c).cast("int")
    return F.when(plausible_year(year), year - year % 10).otherwise(F.lit(0)).cast("int")


def valid_point(lat: Column | str, lon: Column | str) -> Column:
    """In range and not at (0, 0); never null."""
    lat, lon = _col(lat), _col(lon)
    inside = lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))
    return F.coalesce(inside, F.lit(False))


def cell(c: Column | str, valid: Column | str) -> Column:
    """The whole degree below, where valid."""
    return F.when(_col(valid), F.floor(_col(c)).cast("int"))


def cell_id(lat_cell: Column | str, lon_cell: Column | str) -> Column:
    """"lat_lon"; null where either is null."""
    return F.concat(_col(lat_cell).cast("string"), F.lit("_"), _col(lon_cell).cast("string"))


def hemisphere(lat: Column | str) -> Column:
    return F.when(_col(lat) > 0, "north").when(_col(lat) < 0, "south").when(_col(lat) == 0, "equator")


def license_class(url: Column | str) -> Column:
    """UNSPECIFIED, CC_<terms>_<version>, CC0_<version>, PDM_<version> or OTHER."""
    url = _col(url)
    terms, version = (F.regexp_extract(url, r"licenses/([^/]+)/([^/]+)", g) for g in (1, 2))
    tool, of = (F.regexp_extract(url, r"publicdomain/(zero|mark)/([^/]+)", g) for g in (1, 2))
    dotless = lambda c: F.translate(c, ".", "_")
    return (
        F.when(F.coalesce(F.trim(url), F.lit("")) == "", "UNSPECIFIED")
        .when(terms != "", F.concat(F.lit("CC_"), F.upper(dotless(terms)), F.lit("_"), F.upper(dotless(version))))
        .when(tool == "zero", F.concat(F.lit("CC0_"), F.upper(dotless(of))))
        .when(tool == "mark", F.concat(F.lit("PDM_"), F.upper(dotless(of))))
        .otherwise("OTHER")
    )


def year_of_text(c: Column | str) -> Column:
    """The year of an ISO date-time text, read from its first 19 characters; null where malformed."""
    return F.year(F.try_to_timestamp(F.substring(_col(c), 1, 19)))


def share(predicate: Column | str) -> Column:
    """Aggregate: the share of true among non-null."""
    return F.avg(_col(predicate).cast("int"))


def flag_array(flags: dict[str, Column]) -> Column:
    """Sorted array of the names whose predicate is true."""
    named = [F.when(predicate, F.lit(name)) for name, predicate in flags.items()]
    return F.array_sort(F.array_compact(F.array(*named)))
