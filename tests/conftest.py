import os

import pytest

os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from fieldmark.session import build_session

    shared = tmp_path_factory.mktemp("shared")
    session = build_session(
        "fieldmark-tests",
        cores=4,
        extra={
            "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": f"file://{shared}",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    yield session
    session.stop()
