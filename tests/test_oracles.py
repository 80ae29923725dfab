"""Every fleet query against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from roadloom.plans import feed_queries, fusion_queries, rule_queries, stream_queries  # noqa: F401
from roadloom.plans import queries, route_queries

QUERIES, ORACLE = queries.QUERIES | route_queries.QUERIES, queries.ORACLE | route_queries.ORACLE
SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else round(float(x), 4) if isinstance(x, float) or type(x).__name__ == "Decimal" else x
    return sorted((tuple(fix(r[i]) for i in order) for r in data), key=str), sorted(columns)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got, names = rows(df.columns, df.collect())
    cur = con.execute(ORACLE[name])
    want, want_names = rows([d[0] for d in cur.description], cur.fetchall())
    assert names == want_names and len(got) == len(want)
    assert got == want
