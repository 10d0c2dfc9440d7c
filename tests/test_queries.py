"""Every query against its SQL on the smallest tables, and the entry point."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from loadlens import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, sf_dir, name):
    found = plans.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    assert rows
    if name in plans.ORACLES:
        want = duck.sql(plans.ORACLES[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 5
    assert [r.total for r in rows] == sorted((r.total for r in rows), reverse=True)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
