"""Registered queries against DuckDB on the smallest tables, and the driver's contract."""

import datetime
import decimal
import importlib.util

import duckdb
import pytest

import __spark_entry__ as entry_point
from rolecall.plans.all import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    order = [columns.index(c) for c in sorted(columns)]
    want = sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    rows = entry_point.entry(spark)
    assert rows.columns == ["company_id", "active", "eligible", "uncertain", "ineligible", "unverified"] and rows.count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    if importlib.util.find_spec("rolecall.llm") is None:
        assert not any(n.startswith("op") for n in entry_point.queries())
