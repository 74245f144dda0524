"""The queries that SQL can express, against that SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op3_url_filters", "op8_chat_format"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    want = sorted(map(str, ([row[columns.index(c)] for c in sorted(columns)] for row in cur.fetchall())))
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(str([r[c] for c in sorted(columns)]) for r in got.collect()) == want
