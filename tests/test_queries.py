"""Every query with SQL against DuckDB on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from ledgerloom.plans import registry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{D}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.5g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_duckdb(spark, duck, name):
    made = registry.queries()[name](spark, D)
    cols = sorted(made.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in made.collect())
    cur = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = sorted(tuple(plain(row[names.index(c)]) for c in cols) for row in cur.fetchall())
    assert sorted(names) == cols
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    registry.queries()[name](spark, D).collect()
