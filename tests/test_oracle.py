"""Every registered query with a SQL twin gives the twin's rows."""

import math
import os

import duckdb
import pytest

from arbora import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.sql(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' * os.path.isdir(path)}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, con, sf, name):
    df = catalog.queries()[name](spark, sf)
    rel = con.sql(catalog.oracle_sql()[name])
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    assert sorted(df.columns) == sorted(rel.columns)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    want = sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    assert got == want


def test_names():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.queries()) > 45
