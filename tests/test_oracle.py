"""Every registered query equals its DuckDB SQL on the smallest driver data."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from dialogprep.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "conversations")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _key(r):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = df.columns
    got = sorted((tuple(r) for r in df.collect()), key=_key)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(dcols)
    idx = [dcols.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in idx) for r in res.fetchall()), key=_key)
    assert got == want


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "ids_checksum" in df.columns
