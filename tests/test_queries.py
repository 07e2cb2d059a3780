"""Every query against its SQL on the smallest tables; queries without SQL against a schema and rows."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from tendril.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def rows_of(names, rows):
    at = [names.index(n) for n in sorted(names)]
    return sorted(repr(tuple(plain(r[i]) for i in at)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    if name not in registry.ORACLES:
        assert got.count() > 0
        return
    want = duck.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, map(tuple, got.collect())) == rows_of(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rows_without_oracle_are_few():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"isolation_forest"}
