"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tesselq.plans import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query(spark, duck, name):
    spark_rows = queries.QUERIES[name](spark, DATA)
    columns = sorted(spark_rows.columns)
    sql = duck.sql(queries.ORACLE[name])
    assert columns == sorted(sql.columns)
    mine = duck.from_arrow(spark_rows.select(*columns).toArrow())
    key = lambda r: tuple((x is None, str(x)) for x in r)
    other = duck.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE[name]})")
    assert sorted(mine.fetchall(), key=key) == sorted(other.fetchall(), key=key)


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.ORACLE.keys()))
def test_query_without_sql(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_spanning_forest_of_trade(spark):
    edges = [(r["src"], r["dst"], r["w"]) for r in queries.trade_edges(spark, DATA).collect()]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    total = n = 0
    for a, b, w in sorted(edges, key=lambda e: e[2]):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            total, n = total + w, n + 1
    rows = queries.trade_spanning_forest(spark, DATA).collect()
    assert len(rows) == n and sum(r["w"] for r in rows) == pytest.approx(total)
