"""Every query with a DuckDB statement gives its rows; the others give rows."""

import math

import duckdb
import pytest

from quarry.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rows = df.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    assert got == want


def test_no_query_crosses_large_tables(spark):
    for name in ("flagship_bm25_scored", "txt04_lexical_search", "win12_top_k", "jon01_contained_evidence"):
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "PythonUDF" not in plan
    assert "WindowGroupLimit" in catalog.queries()["win12_top_k"](spark, SF)._jdf.queryExecution().toString()


def test_filters_reach_the_scan(spark):
    plan = catalog.queries()["src11_parquet_scan"](spark, SF)._jdf.queryExecution().toString()
    assert "GreaterThan(n_chars,500)" in plan and "ReadSchema: struct<doc_id:bigint,lang:string,n_chars:bigint>" in plan
