"""Every registered query of the engine against its SQL, on a small table set."""

import math

import duckdb
import pytest

import __spark_entry__ as driver
from loam.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_is_its_sql(spark, con, name):
    df = driver.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    c = con.execute(driver.oracle_sql()[name])
    columns = [x[0] for x in c.description]
    assert sorted(columns) == names
    assert got == sorted(repr([plain(r[columns.index(n)]) for n in names]) for r in c.fetchall())


def test_flagship(spark):
    assert driver.entry(spark).count() > 0
