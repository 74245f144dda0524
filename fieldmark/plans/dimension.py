"""The publisher dimension: datasets joined with organisations, categories normalised, licences classed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S

#: The columns of the dimension; all are strings but the last.
COLUMNS = """
datasetkey dataset_title dataset_type license_url publisher_key installation_key dataset_created dataset_modified
publisher_title publisher_country publisher_city endorsing_node_key publisher_datasets
""".split()
SCHEMA = T.StructType([T.StructField(c, T.LongType() if c == "publisher_datasets" else T.StringType()) for c in COLUMNS])
DATASET_COLUMNS, ORG_COLUMNS = COLUMNS[:8], COLUMNS[4:5] + COLUMNS[8:]


def schema_of(columns: list[str]) -> T.StructType:
    return T.StructType([SCHEMA[c] for c in columns] + [T.StructField("found", T.BooleanType())])


def derive(df: DataFrame) -> DataFrame:
    """license, dataset_year and normalised categories on top of the raw columns; an unknown publisher is UNKNOWN."""
    return df.withColumns(
        {
            "license": S.license_class("license_url"),
            "publisher_country": S.normalised("publisher_country"),
            "dataset_type": S.normalised("dataset_type"),
            "dataset_year": S.year_of_text("dataset_created"),
            "publisher_key": F.coalesce("publisher_key", F.lit("UNKNOWN")),
        }
    )


def build(datasets: DataFrame, organisations: DataFrame) -> DataFrame:
    """Left join of the two small tables, then derive(); a dataset without an organisation stays."""
    orgs = organisations.select(*ORG_COLUMNS).dropDuplicates(["publisher_key"])
    return derive(datasets.select(*DATASET_COLUMNS).join(orgs, "publisher_key", "left").select(*COLUMNS))


def from_cache(spark: SparkSession, datasets_path: str, orgs_path: str) -> DataFrame:
    """From the JSON-lines caches that the registry client writes."""
    read = lambda path, columns: spark.read.schema(schema_of(columns)).json(path)
    return build(read(datasets_path, DATASET_COLUMNS), read(orgs_path, ORG_COLUMNS))


def report(dim: DataFrame) -> dict[str, DataFrame]:
    """Counts of publishers and countries, datasets by publisher, by licence and by type."""
    by = lambda *keys: dim.groupBy(*keys).agg(F.count(F.lit(1)).alias("datasets")).orderBy(F.desc("datasets"), *keys)
    return {
        "totals": dim.agg(F.count(F.lit(1)).alias("datasets"), F.countDistinct("publisher_key").alias("publishers"), F.countDistinct("publisher_country").alias("countries")),
        "by_publisher": by("publisher_key", "publisher_title"),
        "by_license": by("license"),
        "by_type": by("dataset_type"),
    }
