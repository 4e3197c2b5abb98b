"""Every query with SQL gives DuckDB's rows at the smallest scale."""

import math
import os

import duckdb
import pytest

from skysift.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else 0.0 if v == 0 and isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert rows
    if name in ORACLES:
        rel = duck.sql(ORACLES[name])
        at = [rel.columns.index(c) for c in sorted(df.columns)]
        assert sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr) == rows
