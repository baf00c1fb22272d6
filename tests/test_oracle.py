"""Every registered query with SQL, on the smallest tables, against DuckDB."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline"))))
def test_matches_sql(spark, duck, name):
    ours = entry.queries()[name](spark, DATA)
    theirs = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(names)
    want = sorted(repr(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names))) for r in theirs.fetchall())
    got = sorted(repr(tuple(plain(r[c]) for c in sorted(names))) for r in ours.collect())
    assert got == want


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "grade" in df.columns
