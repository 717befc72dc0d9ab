"""Every catalogue query against DuckDB on the smallest tables, where they are there."""

import math
import os

import pytest

from tarn import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    r = duck.sql(sql)
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    assert got == sorted(repr([plain(x[i]) for i in at]) for x in r.fetchall())


def test_increment_of_new_keys_beyond_a_million_parts(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    name = "q108_incr_decr_incrby"
    parts = [(0, 1), (3, 30), (50, 7), (1_000_000, 40), (1_000_050, 9), (1_000_051, 26)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got = sorted((r["key"], r["value"]) for r in queries.queries()[name](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(f"SELECT key, value FROM ({queries.oracle_sql()[name]})").fetchall())
    assert [v for k, v in got if k == "n1000050"] == ["-19", "6"]
