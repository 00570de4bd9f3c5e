"""Queries of readers, writers, claims and set joins. Files are written from the given tables first."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import claims as M
from quarry.operators import finance as N
from quarry.operators.runs import file_fingerprints
from quarry.plans.registry import query
from quarry.plans.standins import FACTS, HITS, QRELS, facts, hits, qrels
from quarry.session import scratch_path, table
from quarry.sources import readers as S


@query(f"WITH {FACTS} SELECT company, metric, value FROM facts WHERE fy = 1997")
def src02_metrics_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    N.wide(facts(spark, sf_dir).where("fy = 1997"), ("revenue", "ebitda", "operating_income")).drop("fy").write.option("header", True).csv(path)
    return S.read_metrics_csv(spark, path)


@query(f"WITH {FACTS} SELECT company, metric, value FROM facts WHERE fy = 1998")
def src04_metrics_json(spark, sf_dir):
    f = facts(spark, sf_dir).where("fy = 1998")
    per = f.groupBy("company").agg(F.map_from_entries(F.collect_list(F.struct("metric", F.col("value").cast("string")))).alias("m"))
    texts = per.select(F.to_json(F.create_map("company", "m")).alias("text"))
    return S.metrics_from_json(texts)


@query("SELECT doc_id, trim(text) AS text FROM documents WHERE trim(coalesce(text, '')) <> '' AND doc_id % 2 = 1 UNION ALL SELECT doc_id, trim(text) FROM documents WHERE trim(coalesce(text, '')) <> '' AND doc_id % 2 = 0")
def src06_plain_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.trim("text").alias("text")).where("text <> ''")


LINES = """l AS (SELECT item_id, CASE WHEN item_id % 10 = 9 THEN 'c0' ELSE 'c' || item_id END AS case_id, item_id % 7 = 3 AS no_evidence, item_id % 11 = 5 AS negative FROM benchmark),
n AS (SELECT *, count(*) OVER (PARTITION BY case_id) AS same FROM l),
r AS (SELECT *, CASE WHEN no_evidence THEN 'missing_evidence' WHEN negative THEN 'negative_page' WHEN same > 1 THEN 'duplicate_id' END AS reason FROM n)"""


def _lines(spark, sf_dir):
    i = F.col("item_id")
    evidence = F.array(F.struct(F.lit("doc").alias("evidence_doc_name"), F.when(i % 11 == 5, -1).otherwise(i % 5).cast("int").alias("evidence_page_num"), F.lit("x").alias("evidence_text")))
    rows = table(spark, sf_dir, "benchmark").select(
        F.when(i % 10 == 9, "c0").otherwise(F.concat(F.lit("c"), i.cast("string"))).alias("case_id"), F.col("text").alias("question"), F.lit("d").alias("doc_name"), F.when(i % 7 != 3, evidence).alias("evidence")
    )
    return rows.select(F.to_json(F.struct("*")).alias("value"))


@query(f"WITH {LINES} SELECT case_id, CAST(item_id % 5 + 1 AS INT) AS page FROM r WHERE reason IS NULL")
def src09_questions(spark, sf_dir):
    good, _ = S.read_questions(_lines(spark, sf_dir))
    return good.select("case_id", F.explode("evidence").alias("e")).select("case_id", "e.page")


@query(f"WITH {LINES} SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1")
def src10_question_rejects(spark, sf_dir):
    _, bad = S.read_questions(_lines(spark, sf_dir))
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE n_chars > 500 AND lang = 'en'")
def src11_parquet_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("n_chars > 500 and lang = 'en'").select("doc_id", "lang", "n_chars")


@query("""WITH k AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'missing_text' WHEN NOT (year(o_orderdate) * CASE WHEN o_custkey % 13 = 0 THEN 2 ELSE 1 END BETWEEN 1900 AND 2100) THEN 'bad_year' WHEN o_custkey % 5 = 0 THEN 'too_few_pages'
  WHEN o_custkey % 7 = 0 THEN 'bad_relevance' WHEN o_custkey % 11 = 0 THEN 'duplicate_doc' WHEN o_custkey % 3 = 0 THEN 'no_positive' ELSE 'ok' END AS reason FROM orders) SELECT reason, count(*) AS n FROM k GROUP BY 1""")
def src12_kpi_rows(spark, sf_dir):
    c = F.col("o_custkey")
    rel = F.when(c % 7 == 0, 5).when(c % 3 == 0, 0).otherwise(1)
    pair = lambda name, r: F.struct(F.lit(name).alias("doc_id"), r.alias("relevance"))
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") != "5-LOW", "text").alias("query_text"),
        (F.year("o_orderdate") * F.when(c % 13 == 0, 2).otherwise(1)).alias("year"),
        F.when(c % 5 == 0, "one" + S.PAGE_SPLIT + "two").otherwise("one" + S.PAGE_SPLIT + "two" + S.PAGE_SPLIT + "three").alias("mmd_text"),
        F.when(c % 11 == 0, F.array(pair("a", rel), pair("a", F.lit(0)))).otherwise(F.array(pair("a", rel), pair("b", F.lit(0)))).alias("qrels"),
    )
    return S.kpi_rejects(rows).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT source AS report, doc_id, text FROM documents), p AS (SELECT 'r' || doc_id AS report_id, unnest([substr(text, 1, 300), ' ', substr(text, 301)]) AS text, unnest([1, 2, 3]) AS no FROM r WHERE text IS NOT NULL)
SELECT report_id, report_id || '/page_' || lpad(CAST(no AS VARCHAR), 4, '0') AS page_id, md5(trim(text)) AS text_md5 FROM p WHERE trim(text) <> ''""")
def src13_page_corpus(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    reports = d.select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("report_id"), F.concat_ws(S.PAGE_SPLIT, F.substring("text", 1, 300), F.lit(" "), F.expr("substring(text, 301)")).alias("mmd_text"))
    pages, _ = S.page_corpus(reports.unionByName(reports))
    return pages.select("report_id", "page_id", F.md5("text").alias("text_md5"))


@query(f"WITH {FACTS} SELECT company AS cik, metric AS tag, CAST(fy AS INT) AS fy, '10-K' AS form, value AS val FROM facts WHERE metric <> 'ebitda'")
def src14_company_facts(spark, sf_dir):
    f = facts(spark, sf_dir)
    unit = F.collect_list(F.struct(F.concat(F.col("fy").cast("string"), F.lit("-12-31")).alias("end"), F.col("value").alias("val"), F.col("fy").cast("int").alias("fy"), F.lit("FY").alias("fp"), F.lit("10-K").alias("form")))
    per = f.groupBy("company", "metric").agg(unit.alias("u"))
    per = per.select("company", "metric", F.struct(F.create_map(F.when(F.col("metric") == "ebitda", "EUR").otherwise("USD"), "u").alias("units")).alias("body"))
    texts = per.groupBy(F.col("company").alias("cik")).agg(F.map_from_entries(F.collect_list(F.struct("metric", "body"))).alias("tags")).select("cik", F.to_json(F.struct(F.struct(F.col("tags").alias("us-gaap")).alias("facts"))).alias("text"))
    return S.company_facts(texts).select("cik", "tag", "fy", "form", "val")


@query(f"""WITH {FACTS}, a(metric, canonical, priority) AS (VALUES ('revenue', 'top', 1), ('ebitda', 'top', 2), ('operating_income', 'profit', 1))
SELECT company, canonical AS metric, arg_min(value, priority) AS value FROM facts JOIN a USING (metric) WHERE fy = 1999 GROUP BY 1, 2""")
def src15_alias_priority(spark, sf_dir):
    rows = facts(spark, sf_dir).where("fy = 1999").select("company", F.col("metric").alias("label"), "value")
    return S.by_alias(rows, [("revenue", "top", 1), ("ebitda", "top", 2), ("operating_income", "profit", 1)])


@query("""SELECT user_id AS ticker, event_type AS provider, value AS price FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value > 5 THEN 0 ELSE 1 END, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, ts DESC, event_id) AS nth FROM events) WHERE nth = 1""")
def src16_market_snapshot(spark, sf_dir):
    place = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    best = Window.partitionBy("user_id").orderBy(F.when(F.col("value") > 5, 0).otherwise(1), place, F.desc("ts"), "event_id")
    return table(spark, sf_dir, "events").withColumn("nth", F.row_number().over(best)).where("nth = 1").select(F.col("user_id").alias("ticker"), F.col("event_type").alias("provider"), F.col("value").alias("price"))


@query("SELECT 'S' || s_suppkey AS ticker, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, s_name || ' Inc.' AS title, trim(regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS normalized FROM supplier")
def src17_issuer_directory(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.to_json(F.create_map(F.col("s_suppkey").cast("string"), F.struct(F.col("s_suppkey").alias("cik_str"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("ticker"), F.concat("s_name", F.lit(" Inc.")).alias("title")))).alias("text"))
    return S.issuer_directory(s)


@query("SELECT doc_id, CAST(('0x' || substr(sha256(source || ':' || doc_id), 1, 16))::UBIGINT & 9223372036854775807::UBIGINT AS BIGINT) AS row_id FROM documents")
def src19_stable_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.stable_id(F.concat_ws(":", "source", F.col("doc_id").cast("string"))).alias("row_id"))


@query("""WITH m AS (SELECT doc_id, greatest(1, ceil(n_chars / 2800))::BIGINT AS expected FROM documents), s AS (SELECT doc_id, greatest(CASE WHEN length(text) > 0 THEN 1 ELSE 0 END, ceil(length(coalesce(text, '')) / 2800))::BIGINT AS stored FROM documents WHERE doc_id % 10 <> 4)
SELECT doc_id, expected, coalesce(stored, 0) AS stored FROM m LEFT JOIN s USING (doc_id) WHERE expected <> coalesce(stored, 0)""")
def src20_rebuild_check(spark, sf_dir):
    from quarry.operators.chunking import paginate

    d = table(spark, sf_dir, "documents")
    expected = d.select("doc_id", F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 2800)).cast("long").alias("expected"))
    stored = paginate(d.where("doc_id % 10 <> 4").select("doc_id", "text")).groupBy("doc_id").agg(F.count("*").alias("stored"))
    return expected.hint("merge").join(stored, "doc_id", "left").select("doc_id", "expected", F.coalesce("stored", F.lit(0)).alias("stored")).where("expected <> stored")


@query(f"WITH {FACTS} SELECT company, metric, value, metric <> 'ebitda' AS comparable FROM facts WHERE fy = 2000")
def src21_metrics_export(spark, sf_dir):
    path = scratch_path(spark, "export")
    rows = facts(spark, sf_dir).where("fy = 2000").select("company", "metric", "value", (F.col("metric") != "ebitda").alias("comparable"))
    rows.write.option("header", True).csv(path)
    return spark.read.option("header", True).schema("company string, metric string, value double, comparable boolean").csv(path)


@query(f"WITH {HITS} SELECT DISTINCT query_id AS case_id, mode FROM hits WHERE NOT (mode = 'bm25' AND query_id % 3 = 0)")
def src22_resume(spark, sf_dir):
    cases = hits(spark, sf_dir).select(F.col("query_id").alias("case_id"), "mode").distinct()
    path = scratch_path(spark, "done")
    cases.where("mode = 'bm25' and case_id % 3 = 0").write.mode("append").json(path)
    return S.unfinished(cases, spark.read.schema("case_id long, mode string").json(path))


@query(f"WITH {FACTS}, f AS (SELECT * FROM facts WHERE fy = 1999) SELECT 'company:' || company AS src, 'metric:' || company || '/' || metric AS dst, 'HAS_METRIC' AS relation FROM f")
def src25_graph_edges(spark, sf_dir):
    return S.graph(facts(spark, sf_dir).where("fy = 1999"))[1]


@query(f"WITH {FACTS}, f AS (SELECT * FROM facts WHERE fy = 1999) SELECT DISTINCT 'company:' || company AS id, 'company' AS kind FROM f UNION ALL SELECT 'metric:' || company || '/' || metric, 'metric' FROM f")
def src25_graph_nodes(spark, sf_dir):
    return S.graph(facts(spark, sf_dir).where("fy = 1999"))[0].select("id", "kind")


@query("SELECT d.doc_id, 'doc-' || d.doc_id AS document_id, coalesce(s.s_name, d.source) AS issuer FROM documents d LEFT JOIN supplier s ON s.s_suppkey = d.doc_id")
def src26_stamp_documents(spark, sf_dir):
    registry = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), "s_name")
    return table(spark, sf_dir, "documents").join(registry, "doc_id", "left").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"), F.coalesce("s_name", "source").alias("issuer"))


@query("SELECT page_id, coalesce(nullif(trim(regexp_extract(url, '#(.*)$', 1)), ''), 'NOT_AVAILABLE') AS section FROM pages")
def src27_section_metadata(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.nullif(F.trim(F.regexp_extract("url", "#(.*)$", 1)), F.lit("")), F.lit("NOT_AVAILABLE")).alias("section"))


@query(f"WITH {HITS} SELECT query_id, mode, count(*) AS n, count(DISTINCT chunk_id) = count(*) AS unique_chunks, sha256(string_agg(CAST(chunk_id AS VARCHAR), chr(10) ORDER BY rank)) AS order_sha256 FROM hits GROUP BY 1, 2")
def src28_candidate_cache(spark, sf_dir):
    rows = hits(spark, sf_dir).groupBy("query_id", "mode").agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("d"), F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("c"))  # fifty a list
    return rows.select("query_id", "mode", "n", (F.col("n") == F.col("d")).alias("unique_chunks"), F.sha2(F.array_join(F.transform("c", lambda x: x["chunk_id"].cast("string")), "\n"), 256).alias("order_sha256"))


@query("SELECT r.id AS doc_id, coalesce(CASE WHEN d.n_chars > 1000 THEN 'ready' WHEN d.doc_id IS NOT NULL THEN 'pending' END, 'missing') AS status FROM (SELECT event_id AS id FROM events) r LEFT JOIN documents d ON d.doc_id = r.id")
def src29_index_status(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"))
    known = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 1000, "ready").otherwise("pending").alias("status"))
    return asked.hint("merge").join(known, "doc_id", "left").select("doc_id", F.coalesce("status", F.lit("missing")).alias("status"))


SNAPSHOT = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query()
def src30_snapshot_fingerprint(spark, sf_dir):
    parts = [file_fingerprints(table(spark, sf_dir, t), t) for t in SNAPSHOT]
    return functools.reduce(DataFrame.unionByName, parts)


CLAIMS = FACTS + """, claims AS (SELECT company || '/' || metric || '/' || fy AS claim_id, company, metric, CASE WHEN fy % 3 = 0 THEN value * 1.01 ELSE value END AS value, CASE WHEN fy % 5 = 0 THEN 'eur' ELSE 'usd' END AS unit, 'FY' || fy AS period FROM facts),
evidence AS (SELECT 'e-' || company || '-' || metric || '-' || fy AS evidence_id, company, metric, value, 'usd' AS unit, CASE WHEN fy % 4 = 0 THEN 'low' ELSE 'high' END AS confidence, CASE WHEN fy % 7 <> 0 THEN 'FY' || fy END AS period, CASE WHEN fy % 2 = 0 THEN fy END AS page FROM facts)"""


def _claims(spark, sf_dir):
    fy = F.col("fy")
    return facts(spark, sf_dir).select(
        F.concat_ws("/", "company", "metric", fy.cast("string")).alias("claim_id"), "company", "metric", F.when(fy % 3 == 0, F.col("value") * 1.01).otherwise(F.col("value")).alias("value"), F.when(fy % 5 == 0, "eur").otherwise("usd").alias("unit"), F.concat(F.lit("FY"), fy.cast("string")).alias("period")
    )


def _evidence(spark, sf_dir):
    fy = F.col("fy")
    return facts(spark, sf_dir).select(
        F.concat_ws("-", F.lit("e"), "company", "metric", fy.cast("string")).alias("evidence_id"), "company", "metric", "value", F.lit("usd").alias("unit"), F.when(fy % 4 == 0, "low").otherwise("high").alias("confidence"),
        F.when(fy % 7 != 0, F.concat(F.lit("FY"), fy.cast("string"))).alias("period"), F.when(fy % 2 == 0, fy).alias("page"),
    )


@query(f"""WITH {CLAIMS}, p AS (SELECT c.*, e.evidence_id, CASE WHEN e.evidence_id IS NULL THEN 'no_evidence' WHEN NOT coalesce(abs(c.value - e.value) <= 1e-4 * abs(e.value), false) THEN 'value_mismatch' WHEN c.unit <> e.unit THEN 'unit_mismatch'
  WHEN e.confidence <> 'high' THEN 'low_confidence' WHEN e.period IS NULL THEN 'missing_period' WHEN c.period <> e.period THEN 'period_mismatch' ELSE 'structured_field_bound' END AS reason FROM claims c LEFT JOIN evidence e ON e.company = c.company AND e.metric = c.metric),
b AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY list_position(['structured_field_bound', 'period_mismatch', 'missing_period', 'low_confidence', 'unit_mismatch', 'value_mismatch', 'no_evidence'], reason), evidence_id) AS nth FROM p)
SELECT claim_id, company, metric, reason = 'structured_field_bound' AS matched, reason, CASE WHEN reason = 'structured_field_bound' THEN evidence_id END AS evidence_id FROM b WHERE nth = 1""")
def clm04_structured_match(spark, sf_dir):
    return M.match_structured(_claims(spark, sf_dir), _evidence(spark, sf_dir))


@query(f"""WITH {CLAIMS}, p AS (SELECT c.claim_id, e.evidence_id, row_number() OVER (PARTITION BY c.claim_id ORDER BY e.page IS NULL, e.evidence_id) AS place FROM claims c JOIN evidence e ON e.company = c.company AND e.metric = c.metric WHERE abs(c.value - e.value) <= 1e-4 * abs(e.value))
SELECT * FROM p WHERE place <= 2""")
def jon08_bind_claims(spark, sf_dir):
    return M.bind(_claims(spark, sf_dir), _evidence(spark, sf_dir))


@query(f"""WITH {FACTS}, u AS (SELECT company, metric || fy AS evidence_id, value, 'FY' || fy AS period, 'filing' AS period_source, 0 AS place FROM facts WHERE fy >= 1996 UNION ALL SELECT company, metric || fy, value * 2, 'FY' || fy, 'guess', 1 FROM facts)
SELECT company, evidence_id, value, CASE WHEN period_source IN ('filing', 'caption') THEN period END AS period, period_source FROM (SELECT *, row_number() OVER (PARTITION BY company, evidence_id ORDER BY place, value) AS nth FROM u) WHERE nth = 1""")
def clm01_evidence_pool(spark, sf_dir):
    f = facts(spark, sf_dir)
    part = lambda rows, value, source: rows.select("company", F.concat("metric", F.col("fy").cast("string")).alias("evidence_id"), value.alias("value"), F.concat(F.lit("FY"), F.col("fy").cast("string")).alias("period"), F.lit(source).alias("period_source"))
    return M.evidence_pool([part(f.where("fy >= 1996"), F.col("value"), "filing"), part(f, F.col("value") * 2, "guess")])


ANSWERS = """a AS (SELECT l_orderkey AS answer_id, 't' || l_orderkey % 3 AS tenant_id, CASE WHEN l_orderkey % 4 = 0 THEN 'fact' ELSE 'summary' END AS kind, l_orderkey % 6 <> 0 AS complete, list_distinct(list(CASE WHEN l_quantity > 20 THEN l_partkey END) FILTER (WHERE l_quantity > 20)) AS citations FROM lineitem GROUP BY 1),
ev AS (SELECT p_partkey AS chunk_id, 't' || p_size % 3 AS tenant_id, p_size % 5 <> 0 AS verified, p_size % 7 = 0 AS stale FROM part WHERE p_partkey % 9 <> 0)"""


@query(f"""WITH {ANSWERS}, c AS (SELECT answer_id, tenant_id AS own, unnest(citations) AS chunk_id FROM a), f AS (SELECT answer_id, bool_or(ev.tenant_id IS NULL) AS unknown, coalesce(bool_or(ev.tenant_id <> own), false) AS foreign_, coalesce(bool_or(NOT verified), false) AS unverified, coalesce(bool_or(stale), false) AS stale, count(*) AS n FROM c LEFT JOIN ev USING (chunk_id) GROUP BY 1)
SELECT answer_id, CASE WHEN NOT complete AND coalesce(n, 0) > 0 THEN 'incomplete_with_citations' WHEN kind = 'fact' AND complete AND coalesce(n, 0) = 0 THEN 'fact_without_citation' WHEN unknown THEN 'unknown_citation' WHEN foreign_ THEN 'cross_tenant' WHEN unverified THEN 'unverified' WHEN stale THEN 'stale' ELSE 'ok' END AS reason FROM a LEFT JOIN f USING (answer_id)""")
def clm06_validate_answers(spark, sf_dir):
    key = F.col("l_orderkey")
    answers = table(spark, sf_dir, "lineitem").groupBy(key.alias("answer_id")).agg(F.collect_set(F.when(F.col("l_quantity") > 20, F.col("l_partkey"))).alias("citations"))
    a = F.col("answer_id")
    answers = answers.select("answer_id", F.concat(F.lit("t"), (a % 3).cast("string")).alias("tenant_id"), F.when(a % 4 == 0, "fact").otherwise("summary").alias("kind"), (a % 6 != 0).alias("complete"), "citations")
    allowed = table(spark, sf_dir, "part").where("p_partkey % 9 <> 0").select(F.col("p_partkey").alias("chunk_id"), F.concat(F.lit("t"), (F.col("p_size") % 3).cast("string")).alias("tenant_id"), (F.col("p_size") % 5 != 0).alias("verified"), (F.col("p_size") % 7 == 0).alias("stale"))
    return M.validate_answers(answers, allowed)


@query("""WITH t AS (SELECT o_orderkey AS answer_id, 'see [' || o_custkey % 9 || '] and [' || o_orderkey % 4 || '][x] [2]' AS text FROM orders), m AS (SELECT answer_id, CAST(unnest(list_distinct(regexp_extract_all(text, '\\[(\\d+)\\]', 1))) AS BIGINT) AS marker FROM t),
e AS (SELECT l_orderkey AS answer_id, CAST(l_linenumber AS BIGINT) AS marker, min(l_partkey) AS chunk_id FROM lineitem GROUP BY 1, 2) SELECT answer_id, marker, chunk_id, chunk_id IS NOT NULL AS mapped FROM m LEFT JOIN e USING (answer_id, marker)""")
def clm07_map_markers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    texts = o.select(F.col("o_orderkey").alias("answer_id"), F.concat(F.lit("see ["), (F.col("o_custkey") % 9).cast("string"), F.lit("] and ["), (F.col("o_orderkey") % 4).cast("string"), F.lit("][x] [2]")).alias("text"))
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").cast("long").alias("marker")).agg(F.min("l_partkey").alias("chunk_id"))
    return M.map_markers(texts, e)


@query("""WITH a AS (SELECT o_orderkey AS query_id, o_totalprice AS n, o_orderkey % 3 <> 0 AS cited, o_orderpriority = '5-LOW' AS abstained FROM orders), g AS (SELECT l_orderkey AS query_id, max(l_extendedprice) AS gold FROM lineitem GROUP BY 1)
SELECT query_id, CASE WHEN abstained THEN 'abstain' WHEN gold IS NULL THEN 'invalid_gold' WHEN m AND cited THEN 'numeric_match' WHEN m THEN 'unsupported_match' ELSE 'mismatch' END AS outcome
FROM (SELECT *, len(list_filter([1.0, 1e3, 1e6, 1e9, 1e-3, 1e-6, 1e-9], lambda s: abs(n * s - gold) <= 0.3 * abs(gold))) > 0 AS m FROM a LEFT JOIN g USING (query_id))""")
def clm08_score_answers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.array("o_totalprice").alias("numbers"), (F.col("o_orderkey") % 3 != 0).alias("cited"), (F.col("o_orderpriority") == "5-LOW").alias("abstained"))
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.max("l_extendedprice").alias("gold"))
    return M.score_answers(o, g, 0.3)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def jon13_missing_documents(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey").hint("merge").join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query(f"""WITH {FACTS}, c AS (SELECT DISTINCT company FROM facts), x AS (SELECT company, 'missing_quantitative_results' AS code FROM c WHERE company NOT IN (SELECT company FROM facts WHERE fy = 1995 AND value > 1000000) UNION ALL SELECT company, 'missing_sentiment_analysis' FROM c WHERE company NOT IN (SELECT company FROM facts WHERE metric = 'ebitda' AND value > 1200000)) SELECT * FROM x""")
def jon14_completeness(spark, sf_dir):
    f = facts(spark, sf_dir)
    c = f.select("company").distinct()
    lack = lambda rows, code: c.hint("merge").join(rows.select("company"), "company", "left_anti").withColumn("code", F.lit(code))
    return lack(f.where("fy = 1995 and value > 1000000"), "missing_quantitative_results").unionByName(lack(f.where("metric = 'ebitda' and value > 1200000"), "missing_sentiment_analysis"))


@query("""WITH h AS (SELECT doc_id, CAST(p.range AS BIGINT) AS page FROM documents d, range(64) p WHERE p.range * 2800 < length(d.text)), n AS (SELECT h.doc_id, h.page, h.page + o.range - 1 AS other FROM h, range(3) o)
SELECT n.doc_id, n.page, count(*) AS n_pages, array_to_string(list_sort(list(CAST(h.page AS VARCHAR))), ',') AS pages FROM n JOIN h ON h.doc_id = n.doc_id AND h.page = n.other GROUP BY 1, 2""")
def jon18_neighbour_pages(spark, sf_dir):
    from quarry.operators.chunking import paginate

    h = paginate(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", (F.col("page") - 1).alias("page"))
    near = h.select("doc_id", "page", F.explode(F.sequence(F.col("page") - 1, F.col("page") + 1)).alias("other"))
    found = near.hint("merge").join(h.withColumnRenamed("page", "other"), ["doc_id", "other"])
    return found.groupBy("doc_id", "page").agg(F.count("*").alias("n_pages"), F.array_join(F.array_sort(F.collect_list(F.col("other").cast("string"))), ",").alias("pages"))  # three at most


@query(f"""WITH {HITS}, f AS (SELECT query_id, mode, doc, page, min(rank) AS rank FROM hits GROUP BY ALL) SELECT query_id, mode, doc || '/' || page AS parent, row_number() OVER (PARTITION BY query_id, mode ORDER BY rank) AS parent_rank FROM f""")
def jon17_parent_pages(spark, sf_dir):
    first = hits(spark, sf_dir).groupBy("query_id", "mode", "doc", "page").agg(F.min("rank").alias("rank"))
    order = Window.partitionBy("query_id", "mode").orderBy("rank")
    return first.select("query_id", "mode", F.concat_ws("/", "doc", F.col("page").cast("string")).alias("parent"), F.row_number().over(order).cast("long").alias("parent_rank"))


@query(f"""WITH {QRELS}, z AS (SELECT DISTINCT chunk_id FROM qrels WHERE chunk_id % 4 = 0), g AS (SELECT q.*, z.chunk_id IS NULL AS usable FROM qrels q LEFT JOIN z USING (chunk_id)), n AS (SELECT *, count(CASE WHEN usable THEN 1 END) OVER (PARTITION BY query_id) AS n_usable, count(*) OVER (PARTITION BY query_id) AS n FROM g)
SELECT query_id, chunk_id, n_usable < n AS affected, n_usable = 0 AS blocked FROM n WHERE usable OR n_usable = 0""")
def jon24_scoring_gold(spark, sf_dir):
    own = Window.partitionBy("query_id")
    g = qrels(spark, sf_dir).withColumn("usable", F.col("chunk_id") % 4 != 0).withColumns({"n_usable": F.count_if("usable").over(own), "n": F.count("*").over(own)})
    return g.where("usable or n_usable = 0").select("query_id", "chunk_id", (F.col("n_usable") < F.col("n")).alias("affected"), (F.col("n_usable") == 0).alias("blocked"))


@query("""SELECT o_orderkey, company FROM (SELECT o_orderkey, unnest(list_distinct(['Apple', CASE o_custkey % 3 WHEN 0 THEN 'apple' WHEN 1 THEN 'Oracle' ELSE 'Apple' END, o_orderstatus])) AS company FROM orders)""")
def set05_ordered_distinct(spark, sf_dir):
    m = F.col("o_custkey") % 3
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array_distinct(F.array(F.lit("Apple"), F.when(m == 0, "apple").when(m == 1, "Oracle").otherwise("Apple"), F.col("o_orderstatus")))).alias("company"))


@query("SELECT page_id, regexp_matches(url, '^.+#\\w+$') AS valid, nullif(regexp_extract(url, '#(\\w+)$', 1), '') AS anchor FROM pages")
def flt16_citation_form(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").rlike(r"^.+#\w+$").alias("valid"), F.nullif(F.regexp_extract("url", r"#(\w+)$", 1), F.lit("")).alias("anchor"))


@query("SELECT doc_id, lang, source FROM documents WHERE source = 'src3' AND lang IN ('en', 'fr')")
def flt01_scope_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where((F.col("source") == "src3") & F.col("lang").isin("en", "fr")).select("doc_id", "lang", "source")


@query(f"WITH {HITS}, s AS (SELECT query_id, bool_or(doc LIKE 'D1%') AS strict FROM hits GROUP BY 1) SELECT query_id, mode, rank, chunk_id, NOT strict AS company_filter_relaxed FROM hits JOIN s USING (query_id) WHERE doc LIKE 'D1%' OR (NOT strict AND page = 1)")
def flt03_relaxed_filter(spark, sf_dir):
    h = hits(spark, sf_dir)
    tagged = F.col("doc").like("D1%")
    strict = h.where(tagged).withColumn("company_filter_relaxed", F.lit(False))
    loose = h.where("page = 1").hint("merge").join(strict.select("query_id").distinct(), "query_id", "left_anti").withColumn("company_filter_relaxed", F.lit(True))
    return strict.unionByName(loose).select("query_id", "mode", "rank", "chunk_id", "company_filter_relaxed")


@query(f"WITH {HITS} SELECT query_id, mode, rank, score FROM hits WHERE mode = 'bm25' OR score >= 50000")
def flt05_minimum_score(spark, sf_dir):
    return hits(spark, sf_dir).where((F.col("mode") == "bm25") | F.col("mode").contains("rrf") | (F.col("score") >= 50000)).select("query_id", "mode", "rank", "score")


@query("SELECT event_id, substr(regexp_replace('token=' || user_id || '; key: sk-' || event_id || 'abcdefgh', '(sk-\\w{8,}|token=\\w+)', '***', 'g'), 1, 40) AS message FROM events")
def flt15_redaction(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit("token="), F.col("user_id").cast("string"), F.lit("; key: sk-"), F.col("event_id").cast("string"), F.lit("abcdefgh"))
    return e.select("event_id", F.substring(F.regexp_replace(text, r"(sk-\w{8,}|token=\w+)", "***"), 1, 40).alias("message"))


@query("SELECT c.c_custkey, n.n_name AS nation, n.n_name IS NOT NULL AS found FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_regionkey IN (1, 3)")
def flt17_lookup(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_regionkey in (1, 3)").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    return table(spark, sf_dir, "customer").join(n, "c_nationkey", "left").select("c_custkey", "nation", F.col("nation").isNotNull().alias("found"))


@query("SELECT CASE WHEN n_pages > 1 THEN 'long' ELSE 'short' END AS cohort, count(*) AS n_docs, count(CASE WHEN n_chars = 0 THEN 1 END) AS n_empty, CAST(sum(n_pages) AS BIGINT) AS n_pages, CAST(sum(ceil(n_pages / 10)) AS BIGINT) AS n_calls FROM (SELECT n_chars, greatest(1, ceil(n_chars / 2800))::BIGINT AS n_pages FROM documents) GROUP BY 1")
def agg24_ingestion_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("n_chars", F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 2800)).cast("long").alias("n_pages"))
    return d.groupBy(F.when(F.col("n_pages") > 1, "long").otherwise("short").alias("cohort")).agg(F.count("*").alias("n_docs"), F.count_if(F.col("n_chars") == 0).alias("n_empty"), F.sum("n_pages").alias("n_pages"), F.sum(F.ceil(F.col("n_pages") / 10)).cast("long").alias("n_calls"))


@query(f"WITH {QRELS}, c AS (SELECT q.query_id, q.chunk_id, CASE WHEN p.p_partkey IS NULL THEN 'missing_report' WHEN p.p_size > 45 THEN 'out_of_range' WHEN p.p_size < 4 THEN 'blank' ELSE 'ok' END AS class FROM qrels q LEFT JOIN part p ON p.p_partkey = q.chunk_id) SELECT class, count(*) AS n, count(DISTINCT query_id) AS n_queries FROM c GROUP BY 1")
def agg25_qrel_audit(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), "p_size")
    q = qrels(spark, sf_dir).hint("merge").join(p, "chunk_id", "left")
    kind = F.when(F.col("p_size").isNull(), "missing_report").when(F.col("p_size") > 45, "out_of_range").when(F.col("p_size") < 4, "blank").otherwise("ok")
    return q.groupBy(kind.alias("class")).agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("n_queries"))


@query("SELECT c_mktsegment AS status, count(*) AS n, count(CASE WHEN c_acctbal > 0 THEN 1 END) AS n_ready, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def agg22_receipts(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("n_ready"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT event_type AS status, count(*) AS n, min(value) > 0 AS all_ok FROM events GROUP BY 1")
def agg23_snapshot_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"), (F.min("value") > 0).alias("all_ok"))


@query("""WITH w AS (SELECT time_bucket(INTERVAL 5 minute, ts) AS w, event_type, value FROM events) SELECT epoch_us(w) AS window_us, event_type, count(*) AS n, round(sum(value), 2) AS total FROM w GROUP BY 1, 2""")
def str05_tumbling_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    from quarry.streaming.telemetry import windowed

    return windowed(e, "5 minutes").select(F.unix_micros("start").alias("window_us"), "event_type", "n", F.round("total", 2).alias("total"))


@query()
def str02_delivery(spark, sf_dir):
    """The delivery state of each message: six neighbouring events are one message's, their times in seconds."""
    from quarry.streaming.delivery import delivery_replay

    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("view", "click"), "reserve").when(F.col("event_type") == "purchase", "ack").otherwise("fail")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return delivery_replay(e.select(F.concat_ws("-", F.lit("m"), (F.floor(F.col("event_id") / 6)).cast("string")).alias("message_id"), kind.alias("action"), at.alias("at")))


@query("""WITH RECURSIVE w AS (SELECT event_id // 8 AS thread_id, event_id AS seq, event_id % 3 AS expected, row_number() OVER (PARTITION BY event_id // 8 ORDER BY event_id) AS i FROM events),
r AS (SELECT thread_id, seq, expected, i, expected = 0 AS accepted, CASE WHEN expected = 0 THEN 1 ELSE 0 END AS revision FROM w WHERE i = 1
  UNION ALL SELECT w.thread_id, w.seq, w.expected, w.i, w.expected = r.revision, r.revision + CASE WHEN w.expected = r.revision THEN 1 ELSE 0 END FROM r JOIN w ON w.thread_id = r.thread_id AND w.i = r.i + 1)
SELECT thread_id, seq, expected, accepted FROM r""")
def str07_revisions(spark, sf_dir):
    from quarry.streaming.delivery import checked_revisions

    e = table(spark, sf_dir, "events")
    return checked_revisions(e.select(F.floor(F.col("event_id") / 8).alias("thread_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).alias("expected")))


@query()
def str01_incremental_index(spark, sf_dir):
    from quarry.streaming.delivery import replayed_index

    d = table(spark, sf_dir, "documents").select(F.col("source").alias("tenant_id"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    return replayed_index(spark, d).select("tenant_id", "content", "page", "chunk_no", F.length("text").alias("n_chars"))


@query()
def txt07_hash_embedding(spark, sf_dir):
    from quarry.functions.embedding import embedder

    return table(spark, sf_dir, "documents").select("doc_id", embedder()("text").alias("embedding"))


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\\x{4e00}-\\x{9fff}]+')) AS token FROM documents), h AS (SELECT doc_id, sha256(token) AS h FROM t),
b AS (SELECT doc_id, i.range AS p, sum(16 * (strpos('0123456789abcdef', substr(h, CAST(i.range * 2 + 1 AS BIGINT), 1)) - 1) + strpos('0123456789abcdef', substr(h, CAST(i.range * 2 + 2 AS BIGINT), 1)) - 1) AS s, count(*) AS n FROM h, range(32) i GROUP BY 1, 2),
v AS (SELECT doc_id, k.range AS place, (CAST(s AS DOUBLE) / 255 - 0.5 * n) * (1 + (k.range % 7) * 0.05::DOUBLE) AS v FROM b, range(384) k WHERE k.range % 32 = p), n AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM v GROUP BY 1)
SELECT d.doc_id, k.range AS place, coalesce(round(v / norm, 6), 0.0) AS value FROM documents d CROSS JOIN range(384) k LEFT JOIN v ON v.doc_id = d.doc_id AND v.place = k.range LEFT JOIN n ON n.doc_id = d.doc_id""")
def txt07_embedding_places(spark, sf_dir):
    from quarry.functions.embedding import embedder

    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(embedder(element="double")(F.coalesce("text", F.lit("")))).alias("place", "value"))
    return rows.select("doc_id", F.col("place").cast("long").alias("place"), "value")


@query("""SELECT o_orderkey AS answer_id, CASE o_orderkey % 6 WHEN 0 THEN 'unsupported_schema' WHEN 1 THEN 'cross_tenant' WHEN 2 THEN 'cross_session' WHEN 3 THEN 'unknown_citation' ELSE 'ok' END AS reason FROM orders""")
def clm06_versions_and_sessions(spark, sf_dir):
    """An answer of each order: an old schema, a citation of another tenant's or session's, one that doesn't exist; one that names no session."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").withColumns({"tenant": F.concat(F.lit("t"), (k % 3).cast("string")), "session": F.concat(F.lit("s"), (F.col("o_custkey") % 9).cast("string"))})
    answers = o.select(
        k.alias("answer_id"), F.when(k % 6 == 1, "other").otherwise(F.col("tenant")).alias("tenant_id"), F.when(k % 6 == 2, "elsewhere").when(k % 6 == 4, "").otherwise(F.col("session")).alias("session_id"),
        F.lit("fact").alias("kind"), F.lit(True).alias("complete"), F.array(F.when(k % 6 == 3, -1 - k).otherwise(k)).alias("citations"), F.when(k % 6 == 0, "0.9").otherwise(F.lit(" 1.0 ")).alias("schema_version"),
    )
    allowed = o.select(k.alias("chunk_id"), F.col("tenant").alias("tenant_id"), F.col("session").alias("session_id"), F.lit(True).alias("verified"), F.lit(False).alias("stale"))
    return M.validate_answers(answers, allowed, ("1.0",))


def _exported(spark, sf_dir):
    """A folder with a file of each supplier: a note, a JSON object, CSV with a header, or ORC."""
    folder = scratch_path(spark, "uploads")
    key, name = F.col("s_suppkey"), F.col("s_name")
    note = F.concat(F.lit("# Notes on "), name, F.lit("\n\nFrom nation "), (key % 25).cast("string"), F.lit("\n"))
    json = F.concat(F.to_json(F.struct(name.alias("name"))), F.lit("\n"))
    csv = F.concat(F.lit("name\n"), F.to_csv(F.struct(name.alias("name"))), F.lit("\n"))
    suffix = F.element_at(F.array(*map(F.lit, ("txt", "json", "csv", "orc"))), (key % 4 + 1).cast("int"))
    body = F.when(key % 4 == 0, note).when(key % 4 == 1, json).when(key % 4 == 2, csv).otherwise(name)
    path = F.concat((F.floor(key / 1000)).cast("string"), F.lit("/s_suppkey="), key.cast("string"), F.lit("."), suffix)
    rows = table(spark, sf_dir, "supplier").repartition(spark.sparkContext.defaultParallelism, key)
    S.write_files(rows.select(path.alias("name"), body.alias("body")), folder)
    return folder


def _key(path):
    return F.regexp_extract(path, r"s_suppkey=(\d+)", 1).cast("long").alias("s_suppkey")


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'json' WHEN 2 THEN 'csv' END AS kind, CASE WHEN s_suppkey % 4 < 3 THEN 1 END AS n_pages,
  CASE s_suppkey % 4 WHEN 0 THEN length('# Notes on ' || s_name || '..From nation ' || s_suppkey % 25) + 1 WHEN 1 THEN length('{"name":"' || s_name || '"}') + 1 WHEN 2 THEN length('name.' || s_name) + 1 END AS n_chars,
  CASE WHEN s_suppkey % 4 = 3 THEN 'unsupported_suffix' END AS reason FROM supplier""")
def src01_by_suffix(spark, sf_dir):
    good, bad = S.by_suffix(spark, _exported(spark, sf_dir))
    rows = good.select(_key("path"), "kind", F.size("pages").alias("n_pages"), "n_chars", F.lit(None).cast("string").alias("reason"))
    none = lambda kind: F.lit(None).cast(kind)
    return rows.unionByName(bad.select(_key("path"), none("string").alias("kind"), none("int").alias("n_pages"), none("long").alias("n_chars"), "reason"))


@query("""SELECT s_suppkey, 'Notes on ' || s_name AS title, md5('# Notes on ' || s_name || chr(10) || chr(10) || 'From nation ' || s_suppkey % 25 || chr(10)) AS text_md5 FROM supplier WHERE s_suppkey % 4 = 0""")
def src24_research_notes(spark, sf_dir):
    """Only the notes of a folder with other files in it."""
    from quarry.operators.fact_text import research_notes

    return research_notes(spark, _exported(spark, sf_dir)).select(_key("path"), "title", F.md5("text").alias("text_md5"))
