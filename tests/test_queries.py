"""Every query runs; those with SQL agree with DuckDB row by row."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexloom.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return bytes(v) if isinstance(v, bytearray) else v


def agree(df, sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(names) == sorted(df.columns)
    got = [tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()]
    assert sorted(got, key=repr) == sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in want), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    if name in ORACLE_SQL:
        agree(df, ORACLE_SQL[name], sf)
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
