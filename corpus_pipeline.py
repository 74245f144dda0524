"""A corpus pipeline of five operators: toxicity, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a DataFrame; all but
the last return the columns of documents. run() writes each stage's result as Parquet and reads it as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm import decontaminate, mixing, shards, similar, toxicity
from fieldmark.llm.common import id_mod, release, settle, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5 stay. The model learns from labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(id_mod("doc_id", 5) != 0).select("doc_id", F.col("toxic").alias("label"))
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 or more of their five-word shingles connect, that of the least id stays."""
    return similar.drop_near_duplicates(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other names, numbers or units, go."""
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: documents repeated, and cut where a pass takes a part."""
    mix = mixing.mix_sources(docs)
    return mixing.mixed_documents(mix, "text", docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot on the Hilbert curve."""
    placed, added = shards.shard_documents(docs, 16), ("size", "shard", "slot")
    return placed.select(*[c for c in docs.columns if c not in (*added, "curve", "text_crc32")], *added)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_leaked),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Hashed n-grams, fingerprints and the curve are beyond SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settle(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        release(before)
    name, last = STAGES[-1]
    return last(spark, docs, sf_dir)
