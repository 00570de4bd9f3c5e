"""Queries that read all of their tables."""

import pytest
from pyspark.sql import functions as F

from quarry.operators.runs import file_fingerprints
from quarry.plans import catalog
from quarry.plans.source_queries import SNAPSHOT

SF = "/root/testdata/sf0.001"


def test_dedupe_reads_every_order(spark, tmp_path):
    # orders outside the fifth that win13_dedupe_companies reads
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey % 5 <> 0 and l_orderkey % 8 = 0")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {(f"c{r.c}", f"f{r.f}") for r in lines.select((F.col("l_suppkey") % 9).alias("c"), (F.col("l_partkey") % 700).alias("f")).collect()}
    got = [tuple(r) for r in catalog.queries()["win13_dedupe_all"](spark, str(tmp_path)).select("company", "fingerprint").collect()]
    assert set(got) == want and len(got) == len(want) > 100


@pytest.mark.parametrize("name", ["txt16_all_peer_rows", "txt27_all_vertical_peers"])
def test_peers_of_all_suppliers(spark, name):
    rows = catalog.queries()[name](spark, SF).collect()
    suppliers = {r.s_name for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()}
    assert {r.company for r in rows} == suppliers and len(suppliers) > 2
    old = catalog.queries()[name.replace("_all", "")](spark, SF).collect()
    named = {"Alpha": "Supplier#000000001", "Beta": "Supplier#000000002"}
    assert {(10_000 + r.doc_id, named[r.company], r.metric, r.value) for r in old} == {tuple(r) for r in rows if r.doc_id // 10_000 == 1}


def test_snapshot_covers_every_table_and_row(spark, tmp_path):
    found = {r.file: r for r in catalog.queries()["src30_snapshot_fingerprint"](spark, SF).collect()}
    assert set(found) == {f"{t}.parquet" for t in SNAPSHOT} and found["documents.parquet"].n_rows == spark.read.parquet(f"{SF}/documents.parquet").count()

    def prints(rows, name):
        path = f"{tmp_path}/{name}/t.parquet"
        spark.createDataFrame(rows, "a long, b string").coalesce(1).write.parquet(path)
        read = file_fingerprints(spark.read.parquet(path), "t").collect()
        assert len(read) == 1 and read[0].file.startswith("t.parquet/part-")
        return read[0].content_sha256

    rows = [(i, f"t{i}" if i % 3 else None) for i in range(50)]
    first = prints(rows, "first")
    assert prints(rows, "same") == first
    assert len({first, prints(rows[:-1], "less"), prints(rows[:-1] + [(49, "other")], "other"), prints(rows[::-1], "turned"), prints(rows[:-2] + [(48, ""), rows[-1]], "blank")}) == 5
