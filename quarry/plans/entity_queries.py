"""Queries of companies, hits across companies, answers by arm, and remaining summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import values as V
from quarry.operators import entities as E
from quarry.operators import finance as N
from quarry.operators.chunking import paginate
from quarry.plans.ranking_queries import CASES, _cases
from quarry.plans.registry import query
from quarry.plans.standins import CALLS, FACTS, HITS, QRELS, calls, facts, hits, qrels
from quarry.plans.text_queries import SYN, closed_sql
from quarry.session import table

ALIASES = (("idiot", "Acme"), ("license", "License Co"), ("licensed under", "License Co"), ("the", "The Group"), ("which", "Which"), ("ntion", "Part"))
ALIAS_SQL = "aliases(alias, company) AS (VALUES " + ", ".join(f"('{a}', '{c}')" for a, c in ALIASES) + ")"


@query(f"""WITH {ALIAS_SQL} SELECT DISTINCT doc_id, company FROM documents JOIN aliases
ON CASE WHEN length(alias) < 6 AND regexp_matches(alias, '^[a-z0-9]+$') THEN list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), alias) ELSE contains(lower(text), alias) END""")
def jon11_mentions(spark, sf_dir):
    return E.mentions(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.createDataFrame(list(ALIASES), "alias string, company string"))


@query(f"""WITH {ALIAS_SQL}, m AS (SELECT DISTINCT doc_id, company FROM documents JOIN aliases ON CASE WHEN length(alias) < 6 AND regexp_matches(alias, '^[a-z0-9]+$') THEN list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), alias) ELSE contains(lower(text), alias) END)
SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM m WHERE company = 'License Co')""")
def jon05_issuer_scope(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    found = E.mentions(d.select("doc_id", "text"), spark.createDataFrame(list(ALIASES), "alias string, company string")).where("company = 'License Co'")
    return d.select("doc_id", "lang").hint("merge").join(found, "doc_id", "left_semi")


DIRECTORY = "d AS (SELECT 'T' || c_custkey AS ticker, lower(replace(c_name, '#', ' ')) AS normalized FROM customer)"


@query(f"""WITH {DIRECTORY}, c AS (SELECT CASE s_suppkey % 4 WHEN 0 THEN 'Apple' WHEN 1 THEN 't' || s_suppkey WHEN 2 THEN 'CUSTOMER ' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') ELSE 'customer' END AS company FROM supplier),
u AS (SELECT DISTINCT company FROM c), h AS (SELECT u.company, min(ticker) AS ticker, count(DISTINCT ticker) AS n FROM u JOIN d ON d.normalized = lower(company) OR starts_with(d.normalized, lower(company) || ' ') GROUP BY 1),
s AS (SELECT company, 'AAPL' AS ticker, 'curated' AS method, 0 AS place FROM u WHERE lower(company) = 'apple' UNION ALL SELECT company, ticker, 'ticker', 1 FROM u JOIN d ON d.ticker = upper(company)
  UNION ALL SELECT company, min(ticker), 'title', 2 FROM u JOIN d ON d.normalized = lower(company) GROUP BY 1 UNION ALL SELECT company, ticker, 'unique_title', 3 FROM h WHERE n = 1)
SELECT u.company, b.ticker, b.method FROM u LEFT JOIN (SELECT company, arg_min(ticker, place) AS ticker, arg_min(method, place) AS method FROM s GROUP BY 1) b USING (company)""")
def jon09_tickers(spark, sf_dir):
    directory = table(spark, sf_dir, "customer").select(F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("ticker"), F.lower(F.replace("c_name", F.lit("#"), F.lit(" "))).alias("normalized"))
    k = F.col("s_suppkey")
    name = F.when(k % 4 == 0, "Apple").when(k % 4 == 1, F.concat(F.lit("t"), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("CUSTOMER "), F.lpad(k.cast("string"), 9, "0"))).otherwise("customer")
    companies = table(spark, sf_dir, "supplier").select(name.alias("company")).distinct()
    return E.resolve_tickers(companies, spark.createDataFrame([("Apple", "AAPL")], "name string, ticker string"), directory)


@query("""SELECT item_id, len(list_distinct(list_concat(t, CASE WHEN list_has_any(t, ['risk']) THEN ['risk', '风险', '风险点'] ELSE [] END))) AS n_tokens FROM (SELECT item_id, list_distinct(list_concat(['risk'], list_filter(regexp_extract_all(text, '[a-z0-9_]+'), lambda x: length(x) >= 9))) AS t FROM benchmark)""")
def jon12_synonyms(spark, sf_dir):
    long = F.filter(F.regexp_extract_all("text", F.lit("[a-z0-9_]+"), F.lit(0)), lambda x: F.length(x) >= 9)
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(T.expand_synonyms(F.array_distinct(F.concat(F.array(F.lit("risk")), long)))).cast("long").alias("n_tokens"))


@query(f"""WITH {SYN}, t AS (SELECT item_id, text || CASE item_id % 4 WHEN 0 THEN ' operating_margin' WHEN 1 THEN ' salesforce' WHEN 2 THEN ' profit' ELSE '' END AS text FROM benchmark), {closed_sql("c", "t", "item_id")}
SELECT id AS item_id, len(w) AS n_tokens, md5(array_to_string(list_sort(w), ' ')) AS tokens_md5 FROM c""")
def jon12_closed_tokens(spark, sf_dir):
    """All tokens of a passage, closed; words with a direct hit, with a member inside and inside a member."""
    tail = F.when(F.col("item_id") % 4 == 0, " operating_margin").when(F.col("item_id") % 4 == 1, " salesforce").when(F.col("item_id") % 4 == 2, " profit").otherwise("")
    closed = table(spark, sf_dir, "benchmark").select("item_id", T.closed_tokens(F.concat("text", tail)).alias("w"))
    return closed.select("item_id", F.size("w").cast("long").alias("n_tokens"), F.md5(F.array_join(F.array_sort("w"), " ")).alias("tokens_md5"))


@query("SELECT count(*) AS n_shared, count(*) = 0 AS disjoint FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') a JOIN (SELECT DISTINCT c_custkey AS o_custkey FROM customer WHERE c_acctbal < -900) b USING (o_custkey)")
def jon15_disjointness(spark, sf_dir):
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey").distinct()
    b = table(spark, sf_dir, "customer").where("c_acctbal < -900").select(F.col("c_custkey").alias("o_custkey"))
    return a.join(b, "o_custkey", "left_semi").agg(F.count("*").alias("n_shared"), (F.count("*") == 0).alias("disjoint"))


@query("SELECT page_id, url FROM pages WHERE regexp_extract(url, '://([^/]+)/', 1) IN (SELECT regexp_extract(url, '://([^/]+)/', 1) FROM pages WHERE page_id % 10 = 0)")
def jon16_page_selection(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "://([^/]+)/", 1).alias("company"))
    return p.hint("merge").join(p.where("page_id % 10 = 0").select("company").distinct(), "company", "left_semi").select("page_id", "url")


@query("""WITH s AS (SELECT o_orderkey, [o_orderstatus, CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'P' END] AS q, CASE WHEN o_custkey % 3 = 0 THEN [] WHEN o_custkey % 3 = 1 THEN ['F', 'O', 'P'] ELSE ['O'] END AS u FROM orders)
SELECT o_orderkey, CASE WHEN len(u) = 0 THEN 'query' WHEN list_has_all(u, q) THEN 'explicit' WHEN list_has_any(u, q) THEN 'both' ELSE 'mismatch' END AS resolution FROM s""")
def jon21_company_resolution(spark, sf_dir):
    m = F.col("o_custkey") % 3
    q = F.array("o_orderstatus", F.when(F.col("o_custkey") % 2 == 0, "F").otherwise("P"))
    u = F.when(m == 0, F.array().cast("array<string>")).when(m == 1, F.array(*map(F.lit, "FOP"))).otherwise(F.array(F.lit("O")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", q.alias("q"), u.alias("u"))
    return rows.select("o_orderkey", F.when(F.size("u") == 0, "query").when(F.size(F.array_except("q", "u")) == 0, "explicit").when(F.arrays_overlap("q", "u"), "both").otherwise("mismatch").alias("resolution"))


@query(f"WITH {HITS} SELECT query_id, mode, rank, doc || '#p' || page AS citation, substr('part ' || p_name || ' of ' || p_brand, 1, 20) AS excerpt, score FROM hits JOIN part ON p_partkey = chunk_id WHERE rank <= 5")
def jon27_source_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), F.substring(F.concat(F.lit("part "), "p_name", F.lit(" of "), "p_brand"), 1, 20).alias("excerpt"))
    h = hits(spark, sf_dir, 5).hint("merge").join(p, "chunk_id")
    return h.select("query_id", "mode", "rank", F.concat(F.col("doc"), F.lit("#p"), F.col("page").cast("string")).alias("citation"), "excerpt", "score")


@query("SELECT c_custkey FROM customer WHERE list_contains([c_mktsegment, 'ALL'], 'BUILDING') OR c_mktsegment = 'MACHINERY'")
def flt02_company_tags(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(F.arrays_overlap(F.array("c_mktsegment", F.lit("ALL")), F.array(F.lit("BUILDING"), F.lit("MACHINERY")))).select("c_custkey")


@query(f"WITH {HITS} SELECT query_id, mode, rank FROM hits WHERE lower(doc) = lower('d' || query_id % 400) OR chunk_id % 50 = 0")
def flt04_company_scope(spark, sf_dir):
    tags = F.when(F.col("chunk_id") % 50 == 0, F.array().cast("array<string>")).otherwise(F.array("doc"))
    want = F.concat(F.lit("d"), (F.col("query_id") % 400).cast("string"))
    return hits(spark, sf_dir).withColumn("tags", tags).where((F.size("tags") == 0) | F.exists("tags", lambda c: F.lower(c) == F.lower(want))).select("query_id", "mode", "rank")


@query("""SELECT event_id, coalesce(event_id % 2 = 0 AND value > 5 AND event_type <> 'error' AND user_id % 4 <> 0 AND (event_type <> 'purchase' OR event_id % 3 = 0), false) AS trusted FROM events""")
def flt06_trusted_amount(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(
        "event_id",
        F.when(F.col("event_id") % 2 == 0, "high").otherwise("low").alias("confidence"),
        F.when(F.col("value") > 5, F.col("value")).alias("normalized_value"),
        F.lit("billion_usd").alias("unit"),
        F.when(F.col("event_type") != "error", "USD").otherwise("EUR").alias("currency"),
        F.when(F.col("user_id") % 4 != 0, "annual").otherwise("quarter").alias("period_type"),
        F.when(F.col("event_type") == "purchase", "provider_metadata").otherwise("inline_unit").alias("source"),
        F.lit("p").alias("provider"),
        F.when(F.col("event_id") % 3 == 0, "FY2024").otherwise("latest").alias("period"),
        F.lit(True).alias("is_normalized"),
    )
    return rows.select("event_id", E.trusted_amount(F.col).alias("trusted"))


@query(f"WITH {FACTS} SELECT company, metric, fy FROM facts WHERE value > 500000 AND fy % 2 = 0")
def flt09_verified_claims(spark, sf_dir):
    claims = facts(spark, sf_dir).select("company", "metric", "fy", F.when(F.col("value") > 500000, "verified").otherwise("rejected").alias("verification"), F.when(F.col("fy") % 2 == 0, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>")).alias("evidence_refs"))
    return claims.where((F.col("verification") == "verified") & (F.size("evidence_refs") > 0)).select("company", "metric", "fy")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'confirmation' WHEN 'O' THEN 'exposed_test' ELSE 'tunable' END AS role FROM orders")
def flt20_split_roles(spark, sf_dir):
    roles = spark.createDataFrame([("F", "confirmation"), ("O", "exposed_test"), ("P", "tunable")], "o_orderstatus string, role string")
    return table(spark, sf_dir, "orders").join(F.broadcast(roles), "o_orderstatus", "left").select("o_orderkey", F.coalesce("role", F.lit("tunable")).alias("role"))


SEEN = """h AS (SELECT 'c' || l_suppkey % 9 AS company, 'f' || l_partkey % 700 AS fingerprint, CASE WHEN l_orderkey % 8 = 0 THEN 'c' || l_suppkey % 9 ELSE 'x' END AS tag, 'about c' || l_orderkey % 12 AS text, l_extendedprice AS score, l_orderkey * 100 + l_linenumber * 10 + l_quantity AS rank FROM lineitem)"""


@query(f"""WITH {SEEN}, r AS (SELECT *, tag = company AS alone, contains(text, company) AS named FROM h), a AS (SELECT *, bool_or(alone) OVER (PARTITION BY fingerprint) AS any_alone, first_value(company) OVER (PARTITION BY fingerprint ORDER BY named DESC, score DESC, company) AS winner FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY company, fingerprint ORDER BY rank, score) AS nth FROM a WHERE alone OR (NOT any_alone AND company = winner)) SELECT company, fingerprint FROM k WHERE nth = 1""")
def win13_dedupe_companies(spark, sf_dir):
    return _dedupe(table(spark, sf_dir, "lineitem"))


SEEN_ALL = """h AS (SELECT 'c' || l_suppkey % 9 AS company, 'f' || l_partkey % 700 AS fingerprint, CASE WHEN l_orderkey % 8 = 0 THEN 'c' || l_suppkey % 9 ELSE 'x' END AS tag, 'about c' || l_orderkey % 12 AS text, l_extendedprice AS score, l_orderkey * 100 + l_linenumber * 10 + l_quantity AS rank FROM lineitem)"""


@query(f"""WITH {SEEN_ALL}, r AS (SELECT *, tag = company AS alone, contains(text, company) AS named FROM h), a AS (SELECT *, bool_or(alone) OVER (PARTITION BY fingerprint) AS any_alone, first_value(company) OVER (PARTITION BY fingerprint ORDER BY named DESC, score DESC, company) AS winner FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY company, fingerprint ORDER BY rank, score) AS nth FROM a WHERE alone OR (NOT any_alone AND company = winner)) SELECT company, fingerprint FROM k WHERE nth = 1""")
def win13_dedupe_all(spark, sf_dir):
    return _dedupe(table(spark, sf_dir, "lineitem"))


def _dedupe(li):
    company = F.concat(F.lit("c"), (F.col("l_suppkey") % 9).cast("string"))
    rows = li.select(
        company.alias("company"),
        F.concat(F.lit("f"), (F.col("l_partkey") % 700).cast("string")).alias("fingerprint"),
        F.array(F.when(F.col("l_orderkey") % 8 == 0, company).otherwise("x")).alias("tags"),
        F.concat(F.lit("about c"), (F.col("l_orderkey") % 12).cast("string")).alias("text"),
        F.col("l_extendedprice").alias("score"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.col("l_quantity")).alias("rank"),
    )
    return E.dedupe_across_companies(rows).select("company", "fingerprint")


@query("""WITH f AS (SELECT l_suppkey AS doc_id, CAST(l_linenumber AS BIGINT) AS page, l_returnflag AS metric, CASE l_linestatus WHEN 'O' THEN 'consolidated' ELSE 'segment' END AS scope, CASE WHEN l_partkey % 3 = 0 THEN 'Total' ELSE 'line' END AS label, CASE WHEN l_partkey % 2 = 0 THEN 'html_table' ELSE 'text' END AS source, l_extendedprice AS value, l_orderkey AS fact_id FROM lineitem),
r AS (SELECT *, row_number() OVER w AS place, first_value(scope) OVER w AS best FROM f WINDOW w AS (PARTITION BY doc_id, page, metric ORDER BY CASE scope WHEN 'consolidated' THEN 2 ELSE 1 END DESC, (label = 'Total')::INT DESC, (source = 'html_table')::INT DESC, abs(value) DESC, fact_id))
SELECT doc_id, page, metric, fact_id, scope, place FROM r WHERE place = 1 OR (place = 2 AND scope = 'segment' AND best = 'consolidated')""")
def win09_best_facts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(
        F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("page"), F.col("l_returnflag").alias("metric"), F.when(F.col("l_linestatus") == "O", "consolidated").otherwise("segment").alias("scope"),
        F.when(F.col("l_partkey") % 3 == 0, "Total").otherwise("line").alias("label"), F.when(F.col("l_partkey") % 2 == 0, "html_table").otherwise("text").alias("source"), F.col("l_extendedprice").alias("value"), F.col("l_orderkey").alias("fact_id"),
    )
    return E.best_facts(rows).select("doc_id", "page", "metric", "fact_id", "scope", "place")


@query(f"""WITH {HITS}, d AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY score DESC, mode, chunk_id) AS nth FROM hits) SELECT query_id, doc, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS place FROM d WHERE nth = 1) WHERE place <= 3""")
def win14_citation_table(spark, sf_dir):
    same = Window.partitionBy("query_id", "doc").orderBy(F.desc("score"), "mode", "chunk_id")
    first = hits(spark, sf_dir).withColumn("nth", F.row_number().over(same)).where("nth = 1")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    return first.withColumn("place", F.row_number().over(order).cast("long")).where("place <= 3").select("query_id", "doc", "score", "place")


@query(CASES + """, p AS (SELECT query_id, max(CASE WHEN mode = 'bm25' THEN hit_10 END) AS a, max(CASE WHEN mode = 'dense' THEN hit_10 END) AS b FROM cases GROUP BY 1), f AS (SELECT *, query_id % 7 = 0 AS fallback FROM p)
SELECT count(*) AS n, count(CASE WHEN fallback THEN 1 END) AS n_fallback, count(CASE WHEN NOT fallback AND b > a THEN 1 END) AS gained, count(CASE WHEN NOT fallback AND b < a THEN 1 END) AS lost, count(CASE WHEN NOT fallback AND b = a THEN 1 END) AS unchanged, NOT bool_or(fallback) AS valid FROM f""")
def agg11_ablation_pair(spark, sf_dir):
    one = lambda m: F.max(F.when(F.col("mode") == m, F.col("hit_10")))
    p = _cases(spark, sf_dir).groupBy("query_id").agg(one("bm25").alias("a"), one("dense").alias("b")).withColumn("fallback", F.col("query_id") % 7 == 0)
    ok = ~F.col("fallback")
    return p.agg(
        F.count("*").alias("n"), F.count_if("fallback").alias("n_fallback"), F.count_if(ok & (F.col("b") > F.col("a"))).alias("gained"), F.count_if(ok & (F.col("b") < F.col("a"))).alias("lost"), F.count_if(ok & (F.col("b") == F.col("a"))).alias("unchanged"), (~F.bool_or("fallback")).alias("valid")
    )


@query(CASES + " SELECT mode, round(avg(recall_10) + 1e-9, 3) AS recall_at_k, round(avg(rr) + 1e-9, 3) AS mrr, count(CASE WHEN recall_10 >= 0.02 THEN 1 END) AS passed, count(*) AS n FROM cases GROUP BY 1")
def agg14_chunk_eval(spark, sf_dir):
    return _cases(spark, sf_dir).groupBy("mode").agg(F.round(F.avg("recall_10") + 1e-9, 3).alias("recall_at_k"), F.round(F.avg("rr") + 1e-9, 3).alias("mrr"), F.count_if(F.col("recall_10") >= 0.02).alias("passed"), F.count("*").alias("n"))


@query(CASES + """, p AS (SELECT query_id, max(CASE WHEN mode = 'bm25' THEN rr END) AS a, max(CASE WHEN mode = 'dense' THEN rr END) AS b FROM cases GROUP BY 1) SELECT count(CASE WHEN b > a THEN 1 END) AS gain, count(CASE WHEN b < a THEN 1 END) AS loss, count(CASE WHEN b = a THEN 1 END) AS same, round(avg(b) - avg(a) + 1e-9, 3) AS delta FROM p""")
def agg31_run_deltas(spark, sf_dir):
    one = lambda m: F.max(F.when(F.col("mode") == m, F.col("rr")))
    p = _cases(spark, sf_dir).groupBy("query_id").agg(one("bm25").alias("a"), one("dense").alias("b"))
    return p.agg(F.count_if(F.col("b") > F.col("a")).alias("gain"), F.count_if(F.col("b") < F.col("a")).alias("loss"), F.count_if(F.col("b") == F.col("a")).alias("same"), F.round(F.avg("b") - F.avg("a") + 1e-9, 3).alias("delta"))


@query(f"WITH {CALLS} SELECT provider, round(count(CASE WHEN k > 30 THEN 1 END) / count(*), 4) AS emission_rate, count(CASE WHEN k > 80 THEN 1 END) AS supported, count(error_class) AS unknown, percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms) AS p95 FROM calls GROUP BY 1")
def agg32_citation_suite(spark, sf_dir):
    disc = lambda q: F.expr(f"percentile_disc({q}) within group (order by latency_ms)")
    return calls(spark, sf_dir).groupBy("provider").agg(F.round(F.count_if(F.col("k") > 30) / F.count("*"), 4).alias("emission_rate"), F.count_if(F.col("k") > 80).alias("supported"), F.count("error_class").alias("unknown"), disc(0.5).alias("p50"), disc(0.95).alias("p95"))


@query(f"WITH {HITS}, {QRELS}, j AS (SELECT query_id, mode, min(CASE WHEN relevance >= 2 THEN rank END) AS first FROM hits LEFT JOIN qrels USING (query_id, chunk_id) GROUP BY 1, 2) SELECT mode, round(avg(CASE WHEN first = 1 THEN 1 ELSE 0 END), 4) AS top1, round(avg(coalesce(1.0 / first, 0)), 4) AS mrr FROM j GROUP BY 1")
def agg33_hard_negatives(spark, sf_dir):
    j = hits(spark, sf_dir).join(qrels(spark, sf_dir), ["query_id", "chunk_id"], "left").groupBy("query_id", "mode").agg(F.min(F.when(F.col("relevance") >= 2, F.col("rank"))).alias("first"))
    return j.groupBy("mode").agg(F.round(F.avg(F.when(F.col("first") == 1, 1).otherwise(0)), 4).alias("top1"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 4).alias("mrr"))


@query("WITH s AS (SELECT o_custkey % 17 AS shard, count(*) AS n, count(DISTINCT o_orderkey) AS n_ids FROM orders GROUP BY 1) SELECT count(*) AS n_shards, CAST(sum(n) AS BIGINT) AS n_rows, sum(n) = sum(n_ids) AS disjoint FROM s")
def agg34_shard_totals(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 17).alias("shard")).agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("n_ids"))
    return s.agg(F.count("*").alias("n_shards"), F.sum("n").alias("n_rows"), (F.sum("n") == F.sum("n_ids")).alias("disjoint"))


@query(f"WITH {FACTS} SELECT company, max(CASE WHEN metric = 'revenue' THEN value END) AS revenue, max(CASE WHEN metric = 'ebitda' THEN value END) AS ebitda, coalesce(max(CASE WHEN metric = 'risk' THEN value END), 5.0::DOUBLE) AS risk FROM facts WHERE fy = 1998 GROUP BY 1")
def agg36_chart_data(spark, sf_dir):
    return N.wide(facts(spark, sf_dir).where("fy = 1998"), ("revenue", "ebitda", "risk"), ("company",)).withColumn("risk", F.coalesce("risk", F.lit(5.0)))


@query("""WITH a AS (SELECT o_orderkey, o_orderpriority AS arm, o_totalprice > 250000 AS right_, o_orderstatus = 'P' AS abstained, o_totalprice AS ms FROM orders)
SELECT arm, count(*) AS n, round(count(CASE WHEN right_ AND NOT abstained THEN 1 END) / count(*), 4) AS accuracy, round(count(CASE WHEN abstained THEN 1 END) / count(*), 4) AS abstain_rate, percentile_disc(0.5) WITHIN GROUP (ORDER BY ms) AS p50 FROM a GROUP BY 1""")
def agg39_answer_arms(spark, sf_dir):
    right, gone = F.col("o_totalprice") > 250000, F.col("o_orderstatus") == "P"
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("arm")).agg(
        F.count("*").alias("n"), F.round(F.count_if(right & ~gone) / F.count("*"), 4).alias("accuracy"), F.round(F.count_if(gone) / F.count("*"), 4).alias("abstain_rate"), F.expr("percentile_disc(0.5) within group (order by o_totalprice)").alias("p50")
    )


LEAKS = ("numeric_match", "unsupported_match", "retrieval_pool_miss", "ranking_top10_miss", "generation_abstain")
LEAK_SQL = "CASE WHEN o_totalprice > 400000 THEN 'numeric_match' WHEN o_totalprice > 300000 THEN 'unsupported_match' WHEN o_orderstatus = 'P' THEN 'generation_abstain' ELSE 'retrieval_pool_miss' END"


@query(f"WITH l AS (SELECT {LEAK_SQL} AS leak_class FROM orders), c(leak_class) AS (VALUES {', '.join(f'''('{x}')''' for x in LEAKS)}) SELECT c.leak_class, count(l.leak_class) AS n FROM c LEFT JOIN l USING (leak_class) GROUP BY 1")
def agg40_leak_classes(spark, sf_dir):
    p = F.col("o_totalprice")
    found = table(spark, sf_dir, "orders").select(F.when(p > 400000, "numeric_match").when(p > 300000, "unsupported_match").when(F.col("o_orderstatus") == "P", "generation_abstain").otherwise("retrieval_pool_miss").alias("leak_class")).groupBy("leak_class").agg(F.count("*").alias("n"))
    return spark.createDataFrame([(x,) for x in LEAKS], "leak_class string").join(found, "leak_class", "left").select("leak_class", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH n AS (SELECT source, n_chars, greatest(1, ceil(n_chars / 900))::BIGINT AS chunks, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 64 AS batch FROM documents), b AS (SELECT source, batch, sum(chunks) AS chunks, sum(n_chars) AS chars, count(*) AS docs FROM n GROUP BY 1, 2)
SELECT source, CAST(sum(docs) AS BIGINT) AS n_docs, CAST(sum(chunks) AS BIGINT) AS n_chunks, CAST(sum(chars) AS BIGINT) AS n_chars, CAST(sum(ceil(chunks / 10)) AS BIGINT) AS n_calls FROM b GROUP BY 1""")
def agg41_indexing_plan(spark, sf_dir):
    from quarry.operators.groups import ranked_in_groups

    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 900)).cast("long").alias("chunks"))
    n = ranked_in_groups(rows, ["source"], ["doc_id"]).withColumn("batch", F.floor(F.col("nth") / 64))
    b = n.groupBy("source", "batch").agg(F.sum("chunks").alias("chunks"), F.sum("n_chars").alias("chars"), F.count("*").alias("docs"))
    return b.groupBy("source").agg(F.sum("docs").alias("n_docs"), F.sum("chunks").alias("n_chunks"), F.sum("chars").alias("n_chars"), F.sum(F.ceil(F.col("chunks") / 10)).cast("long").alias("n_calls"))


@query(f"WITH {HITS}, {QRELS}, p AS (SELECT query_id, mode, bool_or(coalesce(relevance, 0) > 0) AS hit FROM hits LEFT JOIN qrels USING (query_id, chunk_id) WHERE rank <= 5 GROUP BY 1, 2) SELECT count(CASE WHEN a.hit AND NOT b.hit THEN 1 END) AS only_bm25, count(CASE WHEN b.hit AND NOT a.hit THEN 1 END) AS only_dense FROM (SELECT * FROM p WHERE mode = 'bm25') a JOIN (SELECT * FROM p WHERE mode = 'dense') b USING (query_id)")
def agg42_pool_hits(spark, sf_dir):
    p = hits(spark, sf_dir, 5).join(qrels(spark, sf_dir), ["query_id", "chunk_id"], "left").groupBy("query_id", "mode").agg(F.bool_or(F.coalesce("relevance", F.lit(0)) > 0).alias("hit"))
    a, b = (p.where(F.col("mode") == m).select("query_id", F.col("hit").alias(x)) for m, x in (("bm25", "a"), ("dense", "b")))
    return a.join(b, "query_id").agg(F.count_if(F.col("a") & ~F.col("b")).alias("only_bm25"), F.count_if(F.col("b") & ~F.col("a")).alias("only_dense"))


@query(f"WITH {FACTS}, u AS (SELECT company, max(fy) FILTER (WHERE value > 900000) AS used FROM facts GROUP BY 1) SELECT company, 2000::BIGINT AS requested, used, CASE WHEN used IS NULL THEN 'missing' WHEN used = 2000 THEN 'aligned' ELSE 'mismatch' END AS status FROM u")
def agg43_period_alignment(spark, sf_dir):
    u = facts(spark, sf_dir).groupBy("company").agg(F.max(F.when(F.col("value") > 900000, F.col("fy"))).alias("used"))
    return u.select("company", F.lit(2000).cast("long").alias("requested"), "used", F.when(F.col("used").isNull(), "missing").when(F.col("used") == 2000, "aligned").otherwise("mismatch").alias("status"))


@query(f"WITH {CALLS} SELECT run_id, CASE WHEN bool_or(provider = 'purchase' AND k > 95) THEN 'document_extracted' WHEN bool_or(provider = 'view' AND k > 90) THEN 'sec_companyfacts' ELSE 'sample_db' END AS structured_source, CASE WHEN bool_or(error_class IS NOT NULL) THEN 'degraded' ELSE 'ok' END AS retrieval_status FROM calls GROUP BY 1")
def agg44_data_sources(spark, sf_dir):
    p, k = F.col("provider"), F.col("k")
    source = F.when(F.bool_or((p == "purchase") & (k > 95)), "document_extracted").when(F.bool_or((p == "view") & (k > 90)), "sec_companyfacts").otherwise("sample_db")
    return calls(spark, sf_dir).groupBy("run_id").agg(source.alias("structured_source"), F.when(F.bool_or(F.col("error_class").isNotNull()), "degraded").otherwise("ok").alias("retrieval_status"))


@query("""WITH s AS (SELECT lang AS role, count(*) AS n_rows, count(DISTINCT source) AS n_sources FROM documents GROUP BY 1), m AS (SELECT role, unnest(['n_rows', 'n_sources']) AS field, unnest([n_rows, n_sources]) AS actual, unnest([n_rows, 20]) AS frozen FROM s) SELECT * FROM m WHERE actual <> frozen OR field = 'n_rows'""")
def agg45_manifest_check(spark, sf_dir):
    s = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("role")).agg(F.count("*").alias("n_rows"), F.count_distinct("source").alias("n_sources"))
    pair = lambda f, a, b: F.struct(F.lit(f).alias("field"), a.alias("actual"), b.alias("frozen"))
    m = s.select("role", F.inline(F.array(pair("n_rows", F.col("n_rows"), F.col("n_rows")), pair("n_sources", F.col("n_sources"), F.lit(20).cast("long")))))
    return m.where("actual <> frozen or field = 'n_rows'")


@query("""SELECT item_id, regexp_matches(lower(text), 'compare|versus|vs\\.?') AS wants_comparison, regexp_matches(lower(text), 'revenue|margin|the') AS wants_metrics, length(text) AS n_chars FROM benchmark""")
def txt29_query_features(spark, sf_dir):
    low = F.lower("text")
    return table(spark, sf_dir, "benchmark").select("item_id", low.rlike(r"compare|versus|vs\.?").alias("wants_comparison"), low.rlike("revenue|margin|the").alias("wants_metrics"), F.length("text").cast("long").alias("n_chars"))


@query("""SELECT page_id, regexp_matches(lower(html), 'disclaimer|not investment advice') AS has_disclaimer, contains(lower(html), 'source') AS has_provenance, length(html) >= 2000 AS long_enough FROM pages""")
def txt36_report_contract(spark, sf_dir):
    low = F.lower("html")
    return table(spark, sf_dir, "pages").select("page_id", low.rlike("disclaimer|not investment advice").alias("has_disclaimer"), low.contains("source").alias("has_provenance"), (F.length("html") >= 2000).alias("long_enough"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_partkey % 3 = 0 THEN round(l_extendedprice / 1e3, 8) WHEN l_partkey % 3 = 1 THEN round(l_extendedprice / 1e6, 8) ELSE round(l_extendedprice, 8) END AS value_billion, CASE WHEN l_returnflag = 'R' THEN 'refused' WHEN l_partkey % 3 = 1 THEN 'low' ELSE 'high' END AS confidence FROM lineitem""")
def txt26_normalized_amounts(spark, sf_dir):
    m, v = F.col("l_partkey") % 3, F.col("l_extendedprice")
    foreign = F.col("l_returnflag") == "R"
    value = F.when(foreign, None).when(m == 0, v / 1e3).when(m == 1, v / 1e6).otherwise(v)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(value, 8).alias("value_billion"), F.when(foreign, "refused").when(m == 1, "low").otherwise("high").alias("confidence"))


@query()
def txt25_metric_amounts(spark, sf_dir):
    """Amounts near labels. The texts are invented and hold no filings, so a caption line made of each
    document's own figures is put before its pages."""
    d = table(spark, sf_dir, "documents")
    lead = F.concat(F.lit("Total revenue FY2024 was $"), F.col("n_chars").cast("string"), F.lit(" million; EBITDA rose to 12%, "), (F.col("doc_id") % 90).cast("string"), F.lit(".5 billion. "))
    return E.extract_amounts(paginate(d.select("doc_id", F.concat(lead, F.coalesce("text", F.lit(""))).alias("text"))))


@query(f"""WITH {FACTS}, w AS (SELECT company, fy, max(CASE WHEN metric = 'revenue' THEN value END) AS r, max(CASE WHEN metric = 'ebitda' THEN value END) AS e FROM facts GROUP BY 1, 2), m AS (SELECT company, fy, round(e / r, 4) AS margin FROM w WHERE r > 0 AND e IS NOT NULL)
SELECT company, arg_max(fy, margin * 10000 + fy / 10000.0) AS fy, max(margin) AS margin, CASE WHEN max(margin) >= 0.25 THEN 'strong' WHEN max(margin) >= 0.15 THEN 'moderate' ELSE 'rejected' END AS thesis FROM m GROUP BY 1""")
def clm03_thesis(spark, sf_dir):
    w = N.wide(facts(spark, sf_dir), ("revenue", "ebitda")).where("revenue > 0 and ebitda is not null").select("company", "fy", F.round(F.col("ebitda") / F.col("revenue"), 4).alias("margin"))
    best = w.groupBy("company").agg(F.max_by("fy", F.col("margin") * 10000 + F.col("fy") / 10000.0).alias("fy"), F.max("margin").alias("margin"))
    return best.withColumn("thesis", F.when(F.col("margin") >= 0.25, "strong").when(F.col("margin") >= 0.15, "moderate").otherwise("rejected"))


@query(f"""WITH {FACTS}, a AS (SELECT company || ':' || metric || ':' || fy AS claim_id, company AS entity, 'absolute' AS claim_type, metric AS metric_name, value FROM facts WHERE fy >= 2000), r AS (SELECT company || ':margin:' || fy, company, 'ratio', 'ebitda_margin', round(e / r, 4) FROM (SELECT company, fy, max(CASE WHEN metric = 'revenue' THEN value END) AS r, max(CASE WHEN metric = 'ebitda' THEN value END) AS e FROM facts WHERE fy >= 2000 GROUP BY 1, 2) WHERE r > 0 AND e IS NOT NULL)
SELECT * FROM a UNION ALL SELECT * FROM r""")
def clm02_build_claims(spark, sf_dir):
    f = facts(spark, sf_dir).where("fy >= 2000")
    absolute = f.select(F.concat_ws(":", "company", "metric", F.col("fy").cast("string")).alias("claim_id"), F.col("company").alias("entity"), F.lit("absolute").alias("claim_type"), F.col("metric").alias("metric_name"), "value")
    w = N.wide(f, ("revenue", "ebitda")).where("revenue > 0 and ebitda is not null")
    ratio = w.select(F.concat_ws(":", "company", F.lit("margin"), F.col("fy").cast("string")).alias("claim_id"), F.col("company").alias("entity"), F.lit("ratio").alias("claim_type"), F.lit("ebitda_margin").alias("metric_name"), F.round(F.col("ebitda") / F.col("revenue"), 4).alias("value"))
    return absolute.unionByName(ratio)


@query(f"WITH {FACTS} SELECT fy AS run_id, NOT bool_or(metric = 'revenue' AND value <> 0) AS fatal_gap, count(DISTINCT company) AS n_companies FROM facts GROUP BY 1")
def qnt11_fatal_gap(spark, sf_dir):
    return facts(spark, sf_dir).groupBy(F.col("fy").alias("run_id")).agg((~F.bool_or((F.col("metric") == "revenue") & (F.col("value") != 0))).alias("fatal_gap"), F.count_distinct("company").alias("n_companies"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'date' WHEN 1 THEN 'quarter' ELSE 'year' END AS kind, CAST(year(o_orderdate) + 10 AS INT) AS year, CASE o_orderkey % 3 WHEN 0 THEN CAST(quarter(o_orderdate) AS INT) WHEN 1 THEN CAST(o_orderkey % 4 + 1 AS INT) END AS quarter FROM orders""")
def fun03_period_identity(spark, sf_dir):
    m, year = F.col("o_orderkey") % 3, (F.year("o_orderdate") + 10).cast("string")
    label = F.when(m == 0, F.concat(year, F.date_format("o_orderdate", "-MM-dd"))).when(m == 1, F.concat(F.lit("Q"), (F.col("o_orderkey") % 4 + 1).cast("string"), F.lit(" "), year)).otherwise(F.concat(F.lit("FY"), year))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.period_identity(label).alias("p")).select("o_orderkey", "p.kind", "p.year", "p.quarter")


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, '{"k":' || json_extract_string(props, '$.k') || ',"type":"' || event_type || '"}' AS canonical FROM events""")
def fun07_json(spark, sf_dir):
    raw = F.concat(F.lit("answer: "), "props", F.lit(" done"))
    k = F.from_json(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), "k int")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.cast("string").alias("k"), F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("type"))).alias("canonical"))


@query("""SELECT event_id, CASE WHEN event_id % 5 < 4 THEN '{"a":[1,{"b":null,"c":"' || event_type || '"}],"k":' || json_extract_string(props, '$.k') || ',"z":{"x":true,"y":' || user_id || '}}' END AS canonical FROM events""")
def fun07_canonical_json(spark, sf_dir):
    """Payloads in fences, in prose, with permuted keys; one in five is broken."""
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    k, kind, user = F.get_json_object("props", "$.k"), F.col("event_type"), F.col("user_id")
    one = text('{"z": {"y": ', user, ', "x": true}, "k": ', k, ', "a": [1, {"c": "', kind, '", "b": null}]}')
    two = text('{"a":[ 1, {"b":null, "c":"', kind, '"} ], "z":{"x":true,"y":', user, '},\n"k":', k, "}")
    said = F.array(one, text("The answer is ", two, " as asked."), text("Here:\n```json\n", one, "\n```\nand {more}."), text("```\n", two, "```"), text("{", kind, ": broken"))
    rows = table(spark, sf_dir, "events").select("event_id", said[(F.col("event_id") % 5).cast("int")].alias("said"))
    return rows.select("event_id", V.canonical_json(V.payload(F.col("said"))).alias("canonical"))


@query("""WITH c AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || '.md#p' || n_chars WHEN 1 THEN source || '#p' WHEN 2 THEN '#p' || n_chars ELSE source || '#px' || n_chars END AS c FROM documents)
SELECT doc_id, doc_id % 4 = 0 AS valid, CASE WHEN doc_id % 4 = 0 THEN regexp_extract(c, '^(.+)#p', 1) END AS document, CASE WHEN doc_id % 4 = 0 THEN CAST(regexp_extract(c, '#p(\\d+)$', 1) AS BIGINT) END AS page FROM c""")
def flt16_page_citations(spark, sf_dir):
    n, source = F.col("n_chars").cast("string"), F.col("source")
    forms = F.array(F.concat(source, F.lit(".md#p"), n), F.concat(source, F.lit("#p")), F.concat(F.lit("#p"), n), F.concat(source, F.lit("#px"), n))
    return table(spark, sf_dir, "documents").select("doc_id", V.citation(forms[(F.col("doc_id") % 4).cast("int")]).alias("c")).select("doc_id", "c.*")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 2 THEN l_extendedprice END AS amount, l_linenumber > 2 AND abs(l_extendedprice - l_extendedprice * (1 + l_tax / 4)) <= greatest(1e-9, abs(l_extendedprice * (1 + l_tax / 4)) * 0.01) AS near FROM lineitem""")
def fun05_sound_numbers(spark, sf_dir):
    """Prices, some of them as NaN or an infinity, and whether they are near to a price with tax."""
    n, price = F.col("l_linenumber"), F.col("l_extendedprice")
    x = F.when(n == 1, F.lit(float("nan"))).when(n == 2, F.lit(float("-inf"))).otherwise(price)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", n, V.sound(x).alias("amount"), V.close_to(x, price * (1 + F.col("l_tax") / 4)).alias("near"))
