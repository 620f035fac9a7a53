"""Every query with SQL against DuckDB on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from spanforge.plans import trace_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(table):
    names = sorted(table.columns)
    out = []
    for r in table[names].itertuples(index=False):
        out.append(tuple(round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v for v in r))
    return names, sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(trace_queries.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = trace_queries.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(trace_queries.ORACLE_SQL[name]).df()
    (gn, g), (wn, w) = rows(got), rows(want)
    assert gn == wn and len(g) == len(w)
    for a, b in zip(g, w):
        assert all(x == y or (isinstance(x, float) and abs(x - y) < 2e-6) for x, y in zip(a, b)), (a, b)


def test_queries_without_sql_run(spark):
    found = entry.queries()
    for name in sorted(set(trace_queries.QUERIES) - set(trace_queries.ORACLE_SQL)):
        assert found[name](spark, SF).count() > 0, name


def test_entry(spark):
    assert {r["system"] for r in entry.entry(spark).collect()} == {"TT", "SN"}
