"""Every query with an oracle gives the rows that DuckDB gives, on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from threadloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 9)
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_oracle(name, spark, sf, duck):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    cur = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = [tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.QUERIES) <= set(entry.queries())


def test_queries_without_oracle_run(spark, sf):
    ci = registry.QUERIES["bootstrap_interval"](spark, sf).first()
    assert 0 <= ci["low"] <= ci["high"] <= 1
    assert registry.QUERIES["redacted_messages"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
