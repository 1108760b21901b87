"""The text queries that SQL can express, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from rasterloom.llm import queries as q

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = q.queries(), q.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    cur = con.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    want = sorted(cur.fetchall(), key=str)
    assert len(got) == len(want)
    assert [x for x in zip(got, want) if x[0] != x[1]] == []
