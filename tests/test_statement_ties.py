"""Queries and their statements on ties, repeated keys and large keys, which the given tables lack."""

import datetime

import duckdb
import pytest

from quarry.plans import catalog

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"


@pytest.fixture
def same(spark, tmp_path):
    """The rows of a query over tables {name: (rows, schema)}, which are those of its statement."""

    def check(name, **tables):
        con = duckdb.connect()
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
        df = catalog.queries()[name](spark, str(tmp_path))
        got = [r.asDict() for r in df.collect()]
        found = con.execute(catalog.oracle_sql()[name])
        columns = [d[0] for d in found.description]
        key = lambda r: repr(sorted(r.items()))
        assert sorted(got, key=key) == sorted((dict(zip(columns, r)) for r in found.fetchall()), key=key)
        return got

    return check


def suppliers(*keys):
    return [(k, f"Supplier#{k:09d}", 1, 10.5) for k in keys], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"


def lines(*rows):
    """Lines of (supplier, part, price, discount, flag, status, year)."""
    return [(1, part, s, i, 10.0, price, discount, 0.0, flag, status, datetime.date(year, 6, 1)) for i, (s, part, price, discount, flag, status, year) in enumerate(rows)], LINE


def test_halves_of_recorded_metrics_are_rounded_up(same):
    rows = lines((2, 1, 25000.0, 0.0, "A", "O", 1995), (2, 2, 18585.0, 0.0, "R", "O", 1995), (4, 1, 1000000.0, 0.0, "A", "O", 1995), (4, 2, 2631231.51, 0.5, "N", "O", 1995))
    got = {(r["entity"], r["name"]): r for r in same("clm09_metric_records", supplier=suppliers(2, 4), lineitem=rows)}
    assert got["Supplier#000000002", "operating_margin"]["value"] == 0.1859
    assert got["Supplier#000000004", "ebitda_margin"]["inputs"].startswith("ebitda=1315615.76,")


def test_halves_of_risks_are_rounded_up(same):
    got = same("qnt05_risk_scores", supplier=suppliers(1), lineitem=lines((1, 1, 25000.0, 0.0, "A", "O", 1997), (1, 2, 17000.0, 0.0, "N", "O", 1997)))
    assert got[0]["financial_risk"] == 6.5  # 9 - 0.17 * 15


def test_sections_keep_digits_at_their_ends(same):
    texts = [(1, "01 a 0"), (2, " x \n1 y 1\n z2 ")]
    assert len(same("src05_markdown_sections", documents=(texts, "doc_id long, text string"))) == 4


def test_best_hit_of_parts_beyond_a_million(same):
    got = same("jon26_company_bundles", supplier=suppliers(1), lineitem=lines((1, 2500000, 900.0, 0.0, "A", "F", 1995), (1, 3, 800.0, 0.0, "A", "F", 1995)))
    assert got[0]["best_chunk"] == 2500000


def test_one_title_of_a_ticker_listed_twice(same):
    orders = [(4, 5)], "o_orderkey long, o_custkey long"
    got = same("jon10_universe", supplier=suppliers(17581, 5), orders=orders)
    assert [(r["company"], r["ticker"]) for r in got if r["method"] == "query_token"] == [("Supplier#000000005", "TKFAA")]
