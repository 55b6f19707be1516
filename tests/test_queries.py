"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from zonalspark.plans.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(round(v, 9))
    return None if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    mine = sorted(repr([plain(v) for v in row]) for row in df.select(names).collect())
    theirs = duck.execute(ORACLE_SQL[name])
    held = [x[0] for x in theirs.description]
    assert sorted(held) == names
    at = [held.index(n) for n in names]
    assert mine == sorted(repr([plain(row[i]) for i in at]) for row in theirs.fetchall())
