"""Every query with SQL gives the rows that DuckDB gives; the others run and keep their schema."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__
from lodestone import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_match_sql(spark, duck, name):
    got = catalog.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    relation = duck.sql(ORACLES[name])
    at = [relation.columns.index(c) for c in columns]
    assert sorted(relation.columns) == columns
    theirs = sorted((tuple(plain(r[k]) for k in at) for r in relation.fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLES)))
def test_queries_without_sql_run(spark, name):
    df = catalog.queries()[name](spark, DATA)
    assert df.columns and df.count() >= 0


def test_entry_and_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
