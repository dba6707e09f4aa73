"""Every registered query against its DuckDB oracle on the smallest data."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from mnemospark.sources.tables import TABLES
from tests.conftest import SF_SMALL

QUERIES = E.queries()
ORACLE = E.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else v.isoformat()
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_entry_contract(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols = df.columns
    rows = df.collect()
    if name not in ORACLE:
        assert len(rows) >= 0
        return
    cur = con.execute(ORACLE[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(dcols)
    order = lambda cs: sorted(range(len(cs)), key=lambda i: cs[i])
    a = sorted((tuple(norm(r[i]) for i in order(cols)) for r in rows), key=repr)
    b = sorted((tuple(norm(r[i]) for i in order(dcols)) for r in cur.fetchall()), key=repr)
    assert a == b
