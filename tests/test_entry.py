"""The driver contract, and every registered query against its DuckDB oracle
at sf0.001 (the driver repeats this at sf0.01)."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF0001

ROWS_ONLY: set[str] = set()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "month_key" in df.columns


def test_every_query_has_an_oracle_or_is_declared_rows_only():
    from qalytics.plans.catalog import QUERIES

    assert set(QUERIES) - set(E.oracle_sql()) == ROWS_ONLY


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF0001)
    res = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    order = sorted(df.columns)
    s = sorted(repr(tuple(_norm(r[c]) for c in order)) for r in df.collect())
    oi = [ocols.index(c) for c in order]
    o = sorted(repr(tuple(_norm(r[i]) for i in oi)) for r in res.fetchall())
    assert s == o
