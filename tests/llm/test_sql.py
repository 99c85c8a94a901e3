"""The operators that SQL can express, against that SQL: on a small table set, and on tables with sources of odd sizes."""

import math

import duckdb
import pytest

from loam.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "benchmark")


def plain(v):
    return round(v, 9) if isinstance(v, float) and math.isfinite(v) else v


def agree(spark, name, folder):
    df = queries.QUERIES[name](spark, folder)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder if t == "documents" else SF}/{t}.parquet{'' if folder == SF or t != "documents" else '/*.parquet'}')")
    c = con.execute(queries.ORACLE_SQL[name])
    columns = [x[0] for x in c.description]
    assert sorted(columns) == names
    assert got == sorted(repr([plain(r[columns.index(n)]) for n in names]) for r in c.fetchall())
    return len(got)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_is_its_sql(spark, name):
    assert agree(spark, name, SF) > 0


# Words of each source's documents: sources that are capped (one after the other, and at a tie), null, empty, and without words.
SOURCES = {
    "capped": {"a": [3, 1], "b": [5], "c": [900, 40, 7, 1], None: [2, 2]},
    "tied": {"a": [10], "b": [4], "c": [2], "d": [300] * 5},
    "wordless": {"": [0, 0], "a": [0], "b": [17, 0, 3]},
    "alone": {"é": [1, 2, 3, 50]},
    "none": {"a": [0]},
}


@pytest.mark.parametrize("case", sorted(SOURCES))
def test_mixing_of_odd_sources(spark, tmp_path, case):
    rows = [(s, " ".join(["w"] * n) if n else None) for s, sizes in SOURCES[case].items() for n in sizes]
    docs = spark.createDataFrame([(k, text, s) for k, (s, text) in enumerate(rows)], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert agree(spark, "op5_mixing", str(tmp_path)) == len(rows)
