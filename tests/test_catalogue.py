"""Every catalogued query against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from rasterloom import catalogue

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cur = duck.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    order = sorted(columns)
    assert sorted(df.columns) == order
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=str)
    want = sorted((tuple(r[columns.index(c)] for c in order) for r in cur.fetchall()), key=str)
    assert got == want


def test_planted_shifts_are_found(spark):
    rows = catalogue.flagship(spark, DATA).collect()
    assert len(rows) == 124
    assert all((r.dy, r.dx) == (r.by % 3 - 1, r.bx % 3 - 1) for r in rows)


def test_fft_and_sums_agree(spark):
    by_fft = {(r.by, r.bx): (r.dy, r.dx) for r in QUERIES["block_shift_fft"](spark, DATA).collect()}
    by_sum = {(r.by, r.bx): (r.dy, r.dx) for r in QUERIES["block_shift_int"](spark, DATA).collect()}
    assert by_fft == by_sum
