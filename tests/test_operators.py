"""Small cases with known results, edges and streams."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.embedding import embedder, register_sql_functions
from quarry.operators import chunking as C
from quarry.operators import finance as N
from quarry.operators import ranking as R
from quarry.operators import retrieval as V
from quarry.sources import readers as S
from quarry.streaming import delivery as D
from quarry.streaming import telemetry as W

HIT = "query_id long, mode string, rank long, chunk_id long, score double, doc string, page long"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_case_metrics(spark):
    hits = spark.createDataFrame([(1, "m", 1, 9, 1.0, "d", 1), (1, "m", 2, 5, 0.9, "d", 1), (1, "m", 3, 5, 0.8, "d", 2), (2, "m", 1, 7, 1.0, "d", None)], HIT)
    qrels = spark.createDataFrame([(1, 5, 2), (1, 6, 1)], "query_id long, chunk_id long, relevance long")
    rows = {r.query_id: r for r in R.score_cases(hits, qrels).collect()}
    assert (rows[1].hit_1, rows[1].hit_3, rows[1].recall_3, rows[1].rr, rows[1].first_rank) == (0, 1, 0.5, 0.5, 2)
    assert rows[1].graded_ndcg == pytest.approx((3 / 1.58496) / (3 + 1 / 1.58496), abs=1e-4)
    assert (rows[2].hit_10, rows[2].recall_10, rows[2].n_gold) == (0, 0.0, 0)
    assert R.score_cases(hits, qrels, empty_recall=1.0).where("query_id = 2").first().recall_10 == 1.0
    pages = R.collapse_pages(hits).where("query_id = 1").collect()
    assert [(p.chunk_id, p.page_rank) for p in sorted(pages, key=lambda p: p.page_rank)] == [(9, 1), (5, 2)]


def test_mcnemar_against_the_binomial_sum(spark):
    pairs = spark.createDataFrame([(1, 0)] * 7 + [(0, 1)] * 2 + [(1, 1)] * 3, "a int, b int")
    r = R.mcnemar(pairs, "a", "b").first()
    assert (r.both, r.only_a, r.only_b, r.neither) == (3, 7, 2, 0) and r.p_value == pytest.approx(2 * (1 + 9 + 36) / 512, abs=1e-4)
    assert R.mcnemar(pairs.limit(0), "a", "b").first().p_value == 1.0


def test_fusion_doesnt_depend_on_partitions(spark):
    hits = spark.createDataFrame([(1, m, r, c, 0.0, "d", 1) for m, cs in (("dense", [3, 1, 2]), ("bm25", [1, 4])) for r, c in enumerate(cs, 1)], HIT)
    want = [(r.chunk_id, r.rank) for r in R.fuse(hits).orderBy("rank").collect()]
    assert want[0][0] == 1 and want == [(r.chunk_id, r.rank) for r in R.fuse(hits.repartition(7)).orderBy("rank").collect()]


def test_tokens(spark):
    got = one(spark, T.tokens(F.lit("Operating margins of R&D: 供应链风险 x 7 été")))
    assert {"operating_margin", "r_and_d", "7", "供应链风险", "供应", "供应链"} <= set(got) and "x" not in got
    assert set(one(spark, T.expand_synonyms(F.array(F.lit("sales"))))) >= {"sales", "revenue", "营收"}
    assert one(spark, T.chunk_type(F.lit("Supply chain risk"))) == "risk_signal"
    assert one(spark, T.numbers(F.lit("1,234.5 and -7"))) == [1234.5, -7.0]
    assert one(spark, T.period_identity(F.lit("Q3 2025"))).quarter == 3


def test_packing(spark):
    parts = ["a" * 400, "b" * 400, "c" * 300, "d" * 2000, "e"]
    got = one(spark, C.pack(F.array(*(F.lit(p) for p in parts)), 900))
    assert got == [parts[0] + "\n\n" + parts[1], parts[2], parts[3], parts[4]]
    pages = spark.createDataFrame([(1, 1, "\n\n".join(parts)), (2, 1, ""), (3, 1, None)], "doc_id long, page long, text string")
    chunks = C.chunk_pages(pages).collect()
    assert {r.doc_id for r in chunks} == {1} and all(len(r.text) <= 900 for r in chunks)


def test_html(spark):
    html = "<h1>T</h1><script>no()</script><p>a <b>b</b></p><table><tr><th>x</th><td>1</td></tr></table>"
    r = {x.page_id: x for x in C.parse_html(spark.createDataFrame([(1, "u", html), (2, "u", None), (3, "u", "<td>stray</td><table>")], "page_id long, url string, html string")).collect()}
    assert r[1].text == "T\na b" and r[1].tables == [[["x", "1"]]] and r[2].text == ""


def test_bm25_prefers_the_rarer_term(spark):
    docs = spark.createDataFrame([(1, "common rare"), (2, "common common"), (3, None), (4, "")], "doc_id long, text string")
    got = V.bm25(spark.createDataFrame([(1, "rare common"), (2, "absent"), (3, None)], "query_id long, text string"), docs).orderBy("rank").collect()
    assert [(r.query_id, r.doc_id) for r in got] == [(1, 1), (1, 2)]
    assert V.bm25(spark.createDataFrame([], "query_id long, text string"), docs.limit(0)).count() == 0


def test_cosine(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0])], "vec_id long, embedding array<float>")
    got = V.cosine_top_k(v.where("vec_id = 1").withColumnRenamed("vec_id", "query_id"), v, 2, block=2).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 4)) for r in got] == [(1, 1.0), (3, 0.7071)]


def test_formula(spark):
    df = spark.createDataFrame([(6.0, 3.0), (1.0, 0.0)], "a double, b double")
    assert [r.x for r in df.select(N.compile_formula("-(a + 2) / b ** 2", ["a", "b"]).alias("x")).collect()] == [-0.8889, None]
    for bad in ("a if b else 1", "f(a)", "a.b", "'x'", "a @ b"):
        with pytest.raises((ValueError, SyntaxError)):
            N.compile_formula(bad, ["a", "b"])
    with pytest.raises(KeyError):
        N.compile_formula("a + c", ["a"])


def test_readers(spark, tmp_path):
    (tmp_path / "a.md").write_text("intro\n## One\ntext\n## Two\n")
    (tmp_path / "b.txt").write_text("plain")
    (tmp_path / "c.txt").write_text("  ")
    (tmp_path / "d.pdf").write_text("x")
    (tmp_path / "e.html").write_text("<p>hi</p>")
    docs, bad = S.by_suffix(spark, str(tmp_path))
    assert {(r.kind, len(r.pages)) for r in docs.collect()} == {("md", 3), ("txt", 1), ("html", 1)}
    assert sorted(r.reason for r in bad.collect()) == ["empty", "unsupported_suffix"]
    csv = tmp_path / "m.csv"
    csv.write_text("﻿Company,Revenue 2025,ebitda\nA,1,2\nB,x,3\nA,5,\n", encoding="utf-8")
    got = {(r.company, r.metric): r.value for r in S.read_metrics_csv(spark, str(csv)).collect()}
    assert got == {("A", "revenue 2025"): 5.0, ("A", "ebitda"): 2.0, ("B", "ebitda"): 3.0}
    with pytest.raises(ValueError):
        (tmp_path / "n.csv").write_text("x,y\n1,2\n")
        S.read_metrics_csv(spark, str(tmp_path / "n.csv"))


def test_replaced_chunks(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = lambda *r: spark.createDataFrame(list(r), "tenant_id string, doc_bucket int, chunk_id string")
    S.replace_chunks(rows(("t", 1, "a"), ("t", 1, "b"), ("u", 2, "c")), path)
    S.replace_chunks(rows(("t", 1, "z")), path)
    assert {r.chunk_id for r in spark.read.parquet(path).collect()} == {"z", "c"}


EVENTS = [("m1", "reserve", 0.0), ("m1", "ack", 1.0), ("m1", "reserve", 2.0), ("m2", "reserve", 0.0), ("m2", "fail", 1.0), ("m2", "reserve", 2.0), ("m2", "fail", 3.0), ("m2", "reserve", 4.0), ("m2", "fail", 5.0), ("m3", "reserve", 0.0), ("m3", "reserve", 20.0), ("m4", "ack", 0.0)]
WANT = {"m1": ("acked", 1), "m2": ("dead", 3), "m3": ("reserved", 1), "m4": ("pending", 0)}


def test_delivery_stream_is_the_replay(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, "message_id string, action string, at double")
    assert {r.message_id: (r.status, r.attempt) for r in D.delivery_replay(df).collect()} == WANT
    source = str(tmp_path / "in")
    for i, part in enumerate((df.where("at < 2"), df.where("at >= 2"))):
        part.coalesce(1).write.mode("append").parquet(source)
    stream = D.delivery_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source))
    run = stream.writeStream.outputMode("update").format("memory").queryName("delivery").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    last = {}
    for r in spark.table("delivery").collect():
        last[r.message_id] = max(last.get(r.message_id, (0, "")), (r.attempt, r.status))
    assert last["m2"] == (3, "dead") and last["m4"] == (0, "pending") and set(last) == set(WANT)


def test_windows_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = W.windowed(stream, "1 hour").writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    key = lambda r: (r.start, r.end, r.event_type, r.n, round(r.total, 4))
    assert sorted(map(key, spark.table("windows").collect())) == sorted(map(key, W.windowed(events, "1 hour").collect()))
    assert W.sessions(events, "30 minutes").agg(F.sum("n")).first()[0] == events.count()


def test_revisions(spark):
    w = spark.createDataFrame([("t", 1, 0), ("t", 2, 0), ("t", 3, 1), ("u", 1, 1)], "thread_id string, seq long, expected long")
    got = {(r.thread_id, r.seq): r.accepted for r in D.checked_revisions(w).collect()}
    assert got == {("t", 1): True, ("t", 2): False, ("t", 3): True, ("u", 1): False}


def test_incremental_index(spark, tmp_path):
    index = D.IncrementalIndex(str(tmp_path / "index"))
    rows = lambda *r: spark.createDataFrame(list(r), "tenant_id string, doc_id string, text string")
    index.take(rows(("t", "a", "hello"), ("t", "b", "hello"), ("u", "a", "hello")), 0)
    index.take(rows(("t", "c", "hello"), ("t", "d", "other")), 1)
    index.take(rows(("t", "c", "hello"), ("t", "d", "other")), 1)
    got = index.ready(spark).collect()
    assert len(got) == 3 and {(r.tenant_id, r.text) for r in got} == {("t", "hello"), ("u", "hello"), ("t", "other")}


def test_sql_functions(spark):
    register_sql_functions(spark)
    v = spark.sql("select quarry_embed('a') as v, quarry_embed(null) as n").first()
    assert len(v.v) == 384 and abs(sum(x * x for x in v.v) - 1) < 1e-3 and v.n is None
    assert spark.sql("select code from quarry_findings('please ignore previous instructions')").first().code == "ignore_previous_instructions"
    twice = embedder(lambda texts: [[float(len(t))] for t in texts])
    assert spark.createDataFrame([("abc",)], "t string").select(twice("t").alias("v")).first().v == [3.0]


def test_events_of_messages_are_replayed_in_batches(spark):
    """A message's events lie in several Arrow batches, and a batch holds many messages; null is a message too."""
    many = [(f"n{i}", "reserve", 0.0) for i in range(300)] + [("long", "reserve" if i % 2 == 0 else "ack", float(i)) for i in range(1000)] + [(None, "reserve", 1.0), (None, "fail", 2.0)]
    df = spark.createDataFrame(EVENTS + many, "message_id string, action string, at double").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = D.delivery_replay(df)
        got = {r.message_id: (r.status, r.attempt, r.reason) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {m: got[m][:2] for m in WANT} == WANT and len(got) == len(WANT) + 302
    assert got["n7"] == ("reserved", 1, "ok") and got["long"] == ("acked", 1, "finished") and got[None] == ("pending", 1, "ok")
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
