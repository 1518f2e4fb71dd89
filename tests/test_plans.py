"""Every plan against its SQL in DuckDB, on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from harborline.plans import PLANS

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {k: v for p in PLANS for k, v in p.queries.items()}
ORACLE = {k: v for p in PLANS for k, v in p.oracle.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLE:
        again = QUERIES[name](spark, FOLDER)
        assert mine == sorted((tuple(plain(r[c]) for c in columns) for r in again.collect()), key=repr)
        return
    found = duck.sql(ORACLE[name])
    names = found.columns
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert mine == theirs
