"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidewell.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "none"
    if isinstance(x, float):
        return f"{x:.6g}" if x != int(x) else str(int(x))
    return str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name not in ORACLE_SQL:
        assert got
        return
    found = sql.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    assert got == sorted(tuple(map(plain, r)) for r in found.select(", ".join(columns)).fetchall())
