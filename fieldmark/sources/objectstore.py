"""Reading a public snapshot from an object store: the connector's settings, the bucket's address, its listing."""

from __future__ import annotations

import re
from urllib.request import urlopen

from . import shards

#: The connector that Spark's Hadoop version wants, and settings for reading large Parquet files without an account.
CONNECTOR = "org.apache.hadoop:hadoop-aws:{hadoop}"
READ_SETTINGS = {
    "spark.hadoop.fs.s3a.aws.credentials.provider": "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider",
    "spark.hadoop.fs.s3a.experimental.input.fadvise": "random",
    "spark.hadoop.fs.s3a.connection.maximum": "96",
    "spark.hadoop.fs.s3a.threads.max": "48",
    "spark.hadoop.fs.s3a.attempts.maximum": "10",
}


def is_bucket(source: str) -> bool:
    return source.startswith("s3a://")


def split(source: str) -> tuple[str, str]:
    """(bucket, prefix) of s3a://bucket/prefix."""
    bucket, _, prefix = source.removeprefix("s3a://").partition("/")
    return bucket, prefix


def settings(source: str, region: str | None = None, endpoint: str | None = None, hadoop: str | None = None) -> dict[str, str]:
    """Session settings that the source needs; none for folders. They must be there when the session starts."""
    if not is_bucket(source):
        return {}
    extra = {"spark.hadoop.fs.s3a.endpoint.region": region, "spark.hadoop.fs.s3a.endpoint": endpoint, "spark.jars.packages": CONNECTOR.format(hadoop=hadoop) if hadoop else None}
    return READ_SETTINGS | {k: v for k, v in extra.items() if v}


def address(bucket: str, region: str | None = None, endpoint: str | None = None) -> str:
    """Where the bucket is listed over HTTP."""
    if endpoint:
        return f"{endpoint.rstrip('/')}/{bucket}"
    return f"https://{bucket}.s3.{region}.amazonaws.com" if region else f"https://{bucket}.s3.amazonaws.com"


def fetch(url: str, timeout: float = 60) -> bytes:
    with urlopen(url, timeout=timeout) as answer:
        return answer.read()


def list_shards(source: str, cache: str | None = None, refresh: bool = False, region: str | None = None, endpoint: str | None = None, get=fetch) -> list[tuple[str, int]]:
    """(path, bytes) of a snapshot's shards, in a bucket or in a folder; a bucket's paths are of the form s3a://bucket/key.

    Objects whose names begin with a dot or underscore are none.
    """
    if not is_bucket(source):
        return shards.list_folder(source)
    bucket, prefix = split(source)
    found = shards.list_bucket(address(bucket, region, endpoint), prefix, get, cache, refresh)
    return [(f"s3a://{bucket}/{key}", size) for key, size in found if not re.search(r"(^|/)[._][^/]*$", key)]
