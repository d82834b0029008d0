"""Every query against its DuckDB SQL on the smallest tables."""

import os
from collections import Counter

import pytest
from conftest import SF

from thicket.plans import catalogue

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalogue.ORACLES:
        assert rows
        return
    cols = sorted(df.columns)
    got = con.sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == cols
    at = [got.columns.index(c) for c in cols]
    assert Counter(tuple(plain(r[c]) for c in cols) for r in rows) == Counter(tuple(plain(r[i]) for i in at) for r in got.fetchall())
