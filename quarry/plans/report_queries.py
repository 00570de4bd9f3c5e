"""Queries of scopes, labels, redaction, manifests, shards, answer arms, alignment and bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import run_reports as M
from quarry.operators import scope as S
from quarry.plans.registry import query
from quarry.plans.standins import CALLS, HITS, calls, hits
from quarry.session import scratch_path, table

TAGGED = """tagged AS (SELECT l_orderkey, l_linenumber, l_partkey, 't' || l_suppkey % 3 AS tenant_id, 's' || l_suppkey % 5 AS session_id, 'src' || l_partkey % 4 AS source_document_id, 'd' || l_partkey % 40 AS document_id,
  list_filter(['c' || l_suppkey % 6, CASE WHEN l_linenumber % 2 = 0 THEN 'c' || l_partkey % 6 END], lambda x: x IS NOT NULL AND l_suppkey % 7 > 0) AS companies FROM lineitem)"""


def _tagged(spark, sf_dir):
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    name = lambda lead, n: F.concat(F.lit(lead), n.cast("string"))
    csv = F.when(s % 7 > 0, F.concat_ws(",", name("c", s % 6), F.when(F.col("l_linenumber") % 2 == 0, name("c", p % 6))))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", name("t", s % 3).alias("tenant_id"), name("s", s % 5).alias("session_id"), name("src", p % 4).alias("source_document_id"), name("d", p % 40).alias("document_id"), S.tags(csv).alias("companies"))


@query(f"""WITH {TAGGED} SELECT 'tenant and sources' AS scope, count(*) AS n, sum(l_orderkey) AS total FROM tagged WHERE tenant_id = 't1' AND source_document_id IN ('src1', 'src2')
UNION ALL SELECT 'session and documents', count(*), sum(l_orderkey) FROM tagged WHERE session_id = 's3' AND document_id IN ('d7', 'd9') UNION ALL SELECT 'tenant and companies', count(*), sum(l_orderkey) FROM tagged WHERE tenant_id = 't2' AND list_has_any(companies, ['c1', 'c4'])
UNION ALL SELECT 'all', count(*), sum(l_orderkey) FROM tagged""")
def flt01_scopes(spark, sf_dir):
    """A tenant goes before a session, and sources before documents."""
    rows = _tagged(spark, sf_dir)
    scopes = {
        "tenant and sources": dict(tenant_id="t1", session_id="s9", source_ids=["src1", "src2"], document_ids=["d0"]),
        "session and documents": dict(session_id="s3", document_ids=["d7", "d9"]),
        "tenant and companies": dict(tenant_id="t2", companies=["c1", " c4 ", ""]),
        "all": {},
    }
    parts = [S.in_scope(rows, **kw).agg(F.lit(name).alias("scope"), F.count("*").alias("n"), F.sum("l_orderkey").alias("total")) for name, kw in scopes.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(f"""WITH {TAGGED}, c AS (SELECT *, 'c' || l_partkey % 7 AS company, CASE WHEN l_linenumber % 3 = 0 THEN 'about C' || l_partkey % 7 || ' itself' ELSE 'nothing' END AS text, l_partkey % 300 AS query_id FROM tagged),
t AS (SELECT *, list_contains(companies, company) AS tag, contains(lower(text), company) OR len(companies) = 0 AS loose FROM c), a AS (SELECT *, bool_or(tag) OVER (PARTITION BY query_id) AS any_tag FROM t),
r AS (SELECT query_id, l_orderkey * 10 + l_linenumber AS chunk_id, NOT any_tag AS relaxed, row_number() OVER (PARTITION BY query_id ORDER BY l_orderkey % 1000 DESC, l_orderkey * 10 + l_linenumber) AS place FROM a WHERE tag OR loose AND NOT any_tag)
SELECT query_id, chunk_id, relaxed, place FROM r WHERE place <= 5""")
def flt03_relaxed_companies(spark, sf_dir):
    p = F.col("l_partkey")
    company = F.concat(F.lit("c"), (p % 7).cast("string"))
    text = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("about C"), (p % 7).cast("string"), F.lit(" itself"))).otherwise("nothing")
    rows = _tagged(spark, sf_dir).select((p % 300).alias("query_id"), company.alias("company"), "companies", text.alias("text"), (F.col("l_orderkey") % 1000).alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"))
    return S.relaxed(rows, 5).select("query_id", "chunk_id", "relaxed", "place")


@query("""WITH n AS (SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN c_name WHEN 1 THEN 'Acme ' || c_mktsegment || ', Inc.' WHEN 2 THEN '苹果' || c_nationkey WHEN 3 THEN 'x' WHEN 4 THEN 'Ac?me' WHEN 5 THEN 'T' || chr(65533) || 'sla' WHEN 6 THEN '#1 corp' ELSE repeat('long name ', 9) END AS name FROM customer)
SELECT c_custkey, c_custkey % 8 IN (1, 2) OR c_custkey % 8 = 6 AS plausible FROM n""")
def flt08_company_labels(spark, sf_dir):
    k = F.col("c_custkey") % 8
    name = (
        F.when(k == 0, F.col("c_name")).when(k == 1, F.concat(F.lit("Acme "), "c_mktsegment", F.lit(", Inc."))).when(k == 2, F.concat(F.lit("苹果"), F.col("c_nationkey").cast("string"))).when(k == 3, "x")
        .when(k == 4, "Ac?me").when(k == 5, "T�sla").when(k == 6, "#1 corp").otherwise("long name " * 9)
    )
    return table(spark, sf_dir, "customer").select("c_custkey", S.plausible_label(name, ["#1 Corp"]).alias("plausible"))


SECRET = """m AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'GET /x?api_key=k' || event_id || '&y=1' WHEN 1 THEN 'Authorization: Bearer b' || event_id || ', next' WHEN 2 THEN 'token=' || event_id || chr(10) || 'line two' WHEN 3 THEN 'at https://u:p' || event_id || '@host/ with sk-' || event_id ELSE repeat('plain ', 60) || event_id END AS raw FROM events)"""


@query(f"""WITH {SECRET} SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'GET /x?api_key=[REDACTED]&y=1' WHEN 1 THEN 'Authorization: Bearer [REDACTED], next' WHEN 2 THEN 'token=[REDACTED] line two' WHEN 3 THEN 'at https://[REDACTED]@host/ with [REDACTED]' ELSE substr(raw, 1, 297) || '...' END AS message FROM m""")
def flt15_masked_messages(spark, sf_dir):
    k, id_ = F.col("event_id") % 5, F.col("event_id").cast("string")
    raw = (
        F.when(k == 0, F.concat(F.lit("GET /x?api_key=k"), id_, F.lit("&y=1"))).when(k == 1, F.concat(F.lit("Authorization: Bearer b"), id_, F.lit(", next"))).when(k == 2, F.concat(F.lit("token="), id_, F.lit("\nline two")))
        .when(k == 3, F.concat(F.lit("at https://u:p"), id_, F.lit("@host/ with sk-"), id_)).otherwise(F.concat(F.lit("plain " * 60), id_))
    )
    return table(spark, sf_dir, "events").select("event_id", S.masked(raw).alias("message"))


@query(f"""WITH {HITS} SELECT query_id, 'citation' AS "column", count(*) AS n FROM hits WHERE rank % 9 = 0 GROUP BY 1 UNION ALL SELECT query_id, 'filename', count(*) FROM hits WHERE rank % 14 = 0 GROUP BY 1""")
def flt13_leak_check(spark, sf_dir):
    """Hits lose their texts, and what is left is searched for keys; some of the names hold one."""
    rank = F.col("rank")
    rows = hits(spark, sf_dir).select("query_id", "mode", "rank", "chunk_id", "score", F.when(rank % 14 == 0, "sk-abc_1.pdf").otherwise(F.col("doc")).alias("filename"), F.when(rank % 9 == 0, "Authorization: Bearer x").otherwise("p1").alias("citation"), F.col("doc").alias("text"), F.lit("k").alias("api_key"))
    if S.leaking_columns(rows.schema) != ["text", "api_key"]:
        raise ValueError("the schema check misses columns")
    return S.leaks(S.safe_hits(rows, "query_id"), "query_id")


@query("""WITH a AS (SELECT o_orderkey AS query_id, CASE o_orderkey % 4 WHEN 0 THEN 'SUPPLIER#' || lpad(CAST(o_custkey % 100 AS VARCHAR), 9, '0') WHEN 1 THEN ' Supplier#' || lpad(CAST(o_custkey % 100 AS VARCHAR), 9, '0') || ' ' ELSE 'Nobody' || o_custkey END AS company, CASE WHEN o_orderkey % 3 = 0 THEN ['nation', 'price'] END AS metrics FROM orders),
c AS (SELECT s_name AS company, 'acctbal' AS metric, s_acctbal AS value, NULL AS unit FROM supplier UNION ALL SELECT s_name, 'nation', s_nationkey, 'key' FROM supplier WHERE s_nationkey > 3),
f AS (SELECT query_id, c.company, metric, value, coalesce(unit, 'USD billions') AS unit FROM a JOIN c ON lower(trim(a.company)) = lower(c.company) AND (metrics IS NULL OR list_contains(metrics, metric)))
SELECT query_id, company, true AS found, metric, round(value, 2) AS value, unit FROM f UNION ALL SELECT query_id, coalesce((SELECT s_name FROM supplier WHERE lower(s_name) = lower(trim(a.company))), trim(company)), false, NULL, NULL, NULL FROM a WHERE query_id NOT IN (SELECT query_id FROM f)""")
def flt17_curated_metrics(spark, sf_dir):
    k, number = F.col("o_orderkey") % 4, F.lpad((F.col("o_custkey") % 100).cast("string"), 9, "0")
    name = F.when(k == 0, F.concat(F.lit("SUPPLIER#"), number)).when(k == 1, F.concat(F.lit(" Supplier#"), number, F.lit(" "))).otherwise(F.concat(F.lit("Nobody"), F.col("o_custkey").cast("string")))
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), name.alias("company"), F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("nation"), F.lit("price"))).alias("metrics"))
    s = table(spark, sf_dir, "supplier")
    curated = s.select(F.col("s_name").alias("company"), F.lit("acctbal").alias("metric"), F.col("s_acctbal").alias("value"), F.lit(None).cast("string").alias("unit")).unionByName(s.where("s_nationkey > 3").select(F.col("s_name").alias("company"), F.lit("nation").alias("metric"), F.col("s_nationkey").cast("double").alias("value"), F.lit("key").alias("unit")))
    return S.curated_metrics(asked, curated).withColumn("value", F.round("value", 2))


@query("""WITH r AS (SELECT event_id, event_id % 5 AS k, event_id % 2 = 0 AS company FROM events)
SELECT event_id, CASE k WHEN 0 THEN 'test' WHEN 1 THEN 'test' WHEN 2 THEN 'dev' WHEN 3 THEN 'all' ELSE 'mine' END AS canonical_split, CASE k WHEN 0 THEN 'exposed_test' WHEN 1 THEN 'exposed_test' WHEN 2 THEN 'confirmation' WHEN 3 THEN 'all' ELSE 'mine' END AS split_status,
  CASE k WHEN 2 THEN 'confirmation' WHEN 4 THEN 'unknown' ELSE CASE WHEN company THEN 'post_hoc_paired_diagnostic' ELSE 'exploratory_baseline' END END AS experiment_role, k = 2 AS held_out FROM r""")
def flt20_split_governance(spark, sf_dir):
    k = F.col("event_id") % 5
    runs = table(spark, sf_dir, "events").select("event_id", F.when(k == 0, "test").when(k == 1, " Test-100 ").when(k == 2, "dev-50").when(k == 3, "ALL").otherwise("mine").alias("split"), F.when(F.col("event_id") % 2 == 0, "company").otherwise("corpus").alias("index_scope"))
    return S.split_roles(runs, {"test-100": "test", "dev-50": "dev"}).select("event_id", "canonical_split", "split_status", "experiment_role", "held_out")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'reg-' || doc_id % 50 ELSE 'own-' || doc_id END AS document_id, CASE WHEN doc_id % 3 = 0 THEN 'Co' || doc_id % 7 ELSE lang END AS company, doc_id % 3 = 0 AS pinned FROM documents""")
def src26_pinned_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    parsed = d.select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("filename"), F.concat(F.lit("own-"), F.col("doc_id").cast("string")).alias("document_id"), F.array("lang").alias("companies"))
    registry = d.where("doc_id % 3 = 0").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("filename"), F.concat(F.lit("reg-"), (F.col("doc_id") % 50).cast("string")).alias("document_id"), F.concat(F.lit("Co"), (F.col("doc_id") % 7).cast("string")).alias("company"))
    return S.stamped(parsed, registry).select("doc_id", "document_id", F.col("companies")[0].alias("company"), "pinned")


@query("""WITH p AS (SELECT doc_id, CAST(i.range + 1 AS BIGINT) AS page, substr(text, CAST(i.range * 2800 + 1 AS BIGINT), 2800) AS text FROM documents, range(64) i WHERE i.range * 2800 < length(text))
SELECT doc_id || ':p' || page AS chunk_id, page, CASE WHEN page % 3 = 1 THEN 'Item ' || page ELSE 'NOT_AVAILABLE' END AS section, CASE WHEN doc_id % 2 = 0 THEN lang_ ELSE 'NOT_AVAILABLE' END AS heading, length(text) AS char_count FROM p JOIN (SELECT doc_id AS d, lang AS lang_ FROM documents) ON d = doc_id""")
def src27_page_units(spark, sf_dir):
    from quarry.operators.chunking import paginate

    d = table(spark, sf_dir, "documents")
    head = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("heading"))
    pages = paginate(d.select("doc_id", "text")).hint("merge").join(head, "doc_id").withColumn("section", F.when(F.col("page") % 3 == 1, F.concat(F.lit(" Item "), F.col("page").cast("string"))).when(F.col("page") % 3 == 2, "  "))
    return S.page_units(pages).drop("parent_id")


@query("""SELECT source AS tenant_id, count(DISTINCT doc_id) AS n_documents, count(*) AS n_chunks, count(CASE WHEN version = 2 THEN 1 END) AS n_new FROM (
  SELECT source, doc_id, 1 AS version, i FROM documents, range(3) t(i) WHERE doc_id % 4 IN (0, 1) UNION ALL SELECT source, doc_id, 2, 0 FROM documents WHERE doc_id % 4 = 2) GROUP BY 1""")
def src18_replace_documents(spark, sf_dir):
    """Three chunks of each document are stored; then some documents get one instead, and others none."""
    from quarry.sources.readers import replace_documents, stored_chunks

    d, path = table(spark, sf_dir, "documents"), scratch_path(spark, "stored-chunks")
    rows = lambda docs, n, version: docs.select(F.col("source").alias("tenant_id"), F.col("doc_id").cast("string").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("chunk_no"), F.lit(version).alias("version"))
    replace_documents(rows(d, 3, 1), path)
    replace_documents(rows(d.where("doc_id % 4 = 2"), 1, 2), path, d.where("doc_id % 4 >= 2").select(F.col("source").alias("tenant_id"), F.col("doc_id").cast("string").alias("doc_id")))
    return stored_chunks(spark, path).groupBy("tenant_id").agg(F.count_distinct("doc_id").alias("n_documents"), F.count("*").alias("n_chunks"), F.count_if(F.col("version") == 2).alias("n_new"))


CASES = """cases AS (SELECT 'case-' || o_orderkey AS case_id, 'co-' || CASE WHEN o_custkey % 97 = 0 THEN 0 ELSE o_custkey END AS company, CASE o_custkey % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'test' ELSE 'train' END AS role FROM orders)"""


def _split_cases(spark, sf_dir):
    k = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("case-"), F.col("o_orderkey").cast("string")).alias("case_id"), F.concat(F.lit("co-"), F.when(k % 97 == 0, 0).otherwise(k).cast("string")).alias("company"), F.when(k % 3 == 0, "dev").when(k % 3 == 1, "test").otherwise("train").alias("role"))


MANIFEST = f"""{CASES}, manifest AS (SELECT role, count(DISTINCT case_id) AS n_cases, count(DISTINCT company) AS n_companies, sha256(array_to_string(list_sort(list(DISTINCT case_id)), chr(10))) AS case_sha256, sha256(array_to_string(list_sort(list(DISTINCT company)), chr(10))) AS company_sha256 FROM cases GROUP BY 1)"""


@query(f"WITH {MANIFEST} SELECT * FROM manifest")
def agg26_split_manifest(spark, sf_dir):
    return M.split_manifest(_split_cases(spark, sf_dir))


@query(f"WITH {CASES} SELECT company, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles FROM cases GROUP BY 1 HAVING count(DISTINCT role) > 1")
def agg27_shared_companies(spark, sf_dir):
    return M.shared_companies(_split_cases(spark, sf_dir)).select("company", F.array_join("roles", ",").alias("roles"))


@query(f"""WITH {MANIFEST}, frozen AS (SELECT 'dev' AS role, n_cases, n_companies, case_sha256, company_sha256 FROM manifest WHERE role = 'dev' UNION ALL SELECT role, n_cases + 1, n_companies, case_sha256, 'stale' FROM manifest WHERE role = 'test' UNION ALL SELECT 'gone', 1, 1, 'a', 'b'),
j AS (SELECT coalesce(m.role, f.role) AS role, m.n_cases::VARCHAR AS a1, f.n_cases::VARCHAR AS b1, m.n_companies::VARCHAR AS a2, f.n_companies::VARCHAR AS b2, m.case_sha256 AS a3, f.case_sha256 AS b3, m.company_sha256 AS a4, f.company_sha256 AS b4 FROM manifest m FULL JOIN frozen f ON m.role = f.role)
SELECT role, field, actual, frozen FROM (SELECT role, 'n_cases' AS field, a1 AS actual, b1 AS frozen FROM j UNION ALL SELECT role, 'n_companies', a2, b2 FROM j UNION ALL SELECT role, 'case_sha256', a3, b3 FROM j UNION ALL SELECT role, 'company_sha256', a4, b4 FROM j) WHERE actual IS DISTINCT FROM frozen""")
def agg45_manifest_faults(spark, sf_dir):
    """Against a frozen manifest in which one split is right, one differs, one is unknown and one missing."""
    m = M.split_manifest(_split_cases(spark, sf_dir))
    changed = m.where("role = 'test'").select("role", (F.col("n_cases") + 1).alias("n_cases"), "n_companies", "case_sha256", F.lit("stale").alias("company_sha256"))
    gone = spark.createDataFrame([("gone", 1, 1, "a", "b")], "role string, n_cases long, n_companies long, case_sha256 string, company_sha256 string")
    return M.manifest_faults(m, m.where("role = 'dev'").select("role", "n_cases", "n_companies", "case_sha256", "company_sha256").unionByName(changed).unionByName(gone))


@query(f"""WITH {HITS}, r AS (SELECT DISTINCT query_id % 4 AS run_id, CASE WHEN mode = 'bm25' AND query_id % 4 = 1 AND rank = 1 THEN 9 ELSE query_id // 4 % 3 END AS shard, query_id FROM hits), s AS (SELECT query_id % 4 AS run_id, query_id // 4 % 3 AS shard, count(DISTINCT query_id) AS n_queries, count(*) AS n_hits FROM hits GROUP BY 1, 2),
p AS (SELECT run_id, count(*) AS d, max(n) AS most FROM (SELECT run_id, query_id, count(DISTINCT shard) AS n FROM r GROUP BY 1, 2) GROUP BY 1)
SELECT run_id, count(*) AS n_shards, CAST(sum(n_queries) + max(CASE WHEN run_id = 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_queries, CAST(sum(n_hits) AS BIGINT) AS n_hits, run_id <> 2 AS one_identity, max(most) = 1 AND max(d) = sum(n_queries) + max(CASE WHEN run_id = 3 THEN 1 ELSE 0 END) AS disjoint FROM s JOIN p USING (run_id) GROUP BY run_id""")
def agg34_shard_identity(spark, sf_dir):
    """Run 1 has a query in two shards, run 2 two versions of its settings, and run 3 one query too many."""
    q = F.col("query_id")
    shard = F.floor(q / 4) % 3
    h = hits(spark, sf_dir).withColumn("run_id", q % 4)
    results = h.select("run_id", F.when((F.col("mode") == "bm25") & (F.col("run_id") == 1) & (F.col("rank") == 1), 9).otherwise(shard).alias("shard"), "query_id").distinct()
    shards = h.groupBy("run_id", shard.alias("shard")).agg(F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n_hits"))
    first = (F.col("run_id") == 3) & (F.col("shard") == 0)
    shards = shards.select("run_id", "shard", F.concat(F.lit("v"), F.when((F.col("run_id") == 2) & (F.col("shard") == 0), 2).otherwise(1).cast("string")).alias("identity"), (F.col("n_queries") + F.when(first, 1).otherwise(0)).alias("n_queries"), "n_hits")
    return M.shard_totals(shards, results)


@query("""WITH p AS (SELECT page_id, (page_id % 900 + 100) * 1000 AS gold, url FROM pages), t AS (SELECT page_id, gold, 'chunk' AS strategy, page_id % 2 = 0 AS hit FROM p UNION ALL SELECT page_id, gold, 'page', page_id % 3 <> 0 FROM p UNION ALL SELECT page_id, gold, 'window', page_id % 5 <> 0 FROM p)
SELECT strategy, count(*) AS n_cases, count(CASE WHEN hit THEN 1 END) AS n_recovered FROM t GROUP BY 1""")
def agg35_recoverability(spark, sf_dir):
    k = F.col("page_id")
    gold = (k % 900 + 100) * 1000
    p = table(spark, sf_dir, "pages").select(k.alias("case_id"), gold.cast("double").alias("gold"), k)
    said = F.concat(F.lit("It was $"), F.format_number(gold, 0), F.lit(" in all"))
    pack = lambda name, ok: p.select("case_id", F.lit(name).alias("strategy"), F.when(ok, said).otherwise("It was 7 in all").alias("text"))
    return M.recoverability(p.select("case_id", "gold"), pack("chunk", k % 2 == 0).unionByName(pack("page", k % 3 != 0)).unionByName(pack("window", k % 5 != 0)))


LOST = """lost AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 3 = 0 THEN 'numeric_match' WHEN o_orderkey % 2 = 0 AND o_custkey % 3 = 1 THEN 'unsupported_match' WHEN o_custkey % 5 = 0 THEN 'retrieval_pool_miss' WHEN o_custkey % 7 = 0 THEN 'ranking_top10_miss'
  WHEN o_custkey % 11 < 4 AND o_custkey % 13 < 5 THEN 'evidence_gap_unselected_chunk' WHEN o_custkey % 11 < 4 THEN 'evidence_gap_number_absent' WHEN o_orderkey % 3 = 0 THEN 'generation_abstain' ELSE 'generation_miss' END AS leak FROM orders)"""


def _lost(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    leak = M.leak_class((k % 2 == 0) & (c % 3 < 2), c % 3 == 0, c % 5 != 0, c % 7 != 0, c % 11 >= 4, c % 13 < 5, k % 3 == 0)
    return table(spark, sf_dir, "orders").select(k.alias("k"), leak.alias("leak"))


@query(f"WITH {LOST}, c AS (SELECT unnest(['numeric_match', 'unsupported_match', 'retrieval_pool_miss', 'ranking_top10_miss', 'evidence_gap_unselected_chunk', 'evidence_gap_number_absent', 'generation_abstain', 'generation_miss']) AS leak) SELECT leak, count(k) AS n, count(CASE WHEN k % 4 = 0 THEN 1 END) AS recovered FROM c LEFT JOIN lost USING (leak) GROUP BY 1")
def agg40_leak_counts(spark, sf_dir):
    return M.leak_counts(_lost(spark, sf_dir).withColumn("recovered", F.col("k") % 4 == 0))


ARMS = f"""{LOST}, arms AS (SELECT k AS case_id, a.range AS arm, CASE WHEN leak = 'generation_abstain' THEN 'abstain' WHEN leak IN ('numeric_match', 'unsupported_match') AND k % 5 > 0 OR k % 7 = a.range THEN 'match' ELSE 'miss' END AS outcome, leak = 'numeric_match' AS supported, k % 900 + a.range AS tokens, k % 1000 AS latency_ms FROM lost, range(3) a)"""


def _arms(spark, sf_dir):
    k, a, leak = F.col("case_id"), F.col("arm"), F.col("leak")
    rows = _lost(spark, sf_dir).select(F.col("k").alias("case_id"), "leak", F.explode(F.array(*(F.lit(i).cast("long") for i in range(3)))).alias("arm"))
    outcome = F.when(leak == "generation_abstain", "abstain").when((leak.isin("numeric_match", "unsupported_match") & (k % 5 > 0)) | (k % 7 == a), "match").otherwise("miss")
    return rows.select("arm", "case_id", outcome.alias("outcome"), (leak == "numeric_match").alias("supported"), (k % 900 + a).alias("tokens"), (k % 1000).alias("latency_ms"))


@query(f"""WITH {ARMS} SELECT arm, count(*) AS n, round(count(CASE WHEN outcome = 'match' THEN 1 END) / count(*) + 1e-9, 4) AS accuracy, round(count(CASE WHEN supported THEN 1 END) / count(*) + 1e-9, 4) AS support, round(count(CASE WHEN outcome = 'abstain' THEN 1 END) / count(*) + 1e-9, 4) AS abstain_rate,
  CAST(sum(tokens) AS BIGINT) AS tokens, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms) AS DOUBLE) AS p50, CAST(percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms) AS DOUBLE) AS p95 FROM arms GROUP BY 1""")
def agg39_arm_summary(spark, sf_dir):
    return M.arm_summary(_arms(spark, sf_dir)).withColumns({c: F.col(c).cast("double") for c in ("p50", "p95")})


@query(f"""WITH {ARMS} SELECT x.arm, count(CASE WHEN x.outcome = 'match' AND b.outcome <> 'match' THEN 1 END) AS gained, count(CASE WHEN x.outcome <> 'match' AND b.outcome = 'match' THEN 1 END) AS lost FROM arms x JOIN arms b USING (case_id) WHERE b.arm = 0 AND x.arm > 0 GROUP BY 1""")
def agg39_arm_pairs(spark, sf_dir):
    return M.arm_pairs(_arms(spark, sf_dir), 0)


@query(f"""WITH {CALLS}, c AS (SELECT provider AS arm, k % 4 AS n_cited, CASE WHEN k % 4 > 0 THEN k % 4 - 1 ELSE 0 END AS n_valid, CASE WHEN k % 8 = 1 THEN 1 ELSE 0 END AS n_unknown, CASE WHEN k % 8 = 5 THEN 1 ELSE 0 END AS n_cross, k > 50 AS supported, latency_ms FROM calls)
SELECT arm, count(*) AS n, round(count(CASE WHEN n_cited > 0 THEN 1 END) / count(*) + 1e-9, 4) AS emission_rate, round(count(CASE WHEN n_cited > 0 AND supported THEN 1 END) / greatest(count(CASE WHEN n_cited > 0 THEN 1 END), 1) + 1e-9, 4) AS support_rate, CAST(sum(n_valid) AS BIGINT) AS valid, CAST(sum(n_unknown) AS BIGINT) AS unknown, CAST(sum(n_cross) AS BIGINT) AS cross_scope,
  percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms) AS p95 FROM c GROUP BY 1""")
def agg32_citation_rates(spark, sf_dir):
    k = F.col("k")
    flag = lambda ok: F.when(ok, 1).otherwise(0)
    rows = calls(spark, sf_dir).select(F.col("provider").alias("arm"), (k % 4).alias("n_cited"), F.greatest(k % 4 - 1, F.lit(0)).alias("n_valid"), flag(k % 8 == 1).alias("n_unknown"), flag(k % 8 == 5).alias("n_cross"), (k > 50).alias("supported"), "latency_ms")
    return M.citation_suite(rows)


@query(f"""WITH {LOST}, c AS (SELECT CASE k % 3 WHEN 0 THEN 'numeric' WHEN 1 THEN 'growth' ELSE 'risk_conclusion' END AS claim_type, leak = 'numeric_match' AS ok, k % 4 = 0 AS paged FROM lost)
SELECT claim_type, count(*) AS n, count(CASE WHEN ok THEN 1 END) AS verified, count(CASE WHEN ok AND paged THEN 1 END) AS page_anchored, round(count(CASE WHEN ok THEN 1 END) / count(*) + 1e-9, 4) AS bind_rate FROM c GROUP BY ROLLUP (claim_type)""")
def agg20_binding_by_type(spark, sf_dir):
    k = F.col("k")
    rows = _lost(spark, sf_dir).select(F.when(k % 3 == 0, "numeric").when(k % 3 == 1, "growth").otherwise("risk_conclusion").alias("claim_type"), F.when(F.col("leak") == "numeric_match", "verified").otherwise("rejected").alias("verification"), F.when(k % 4 == 0, 1).alias("page"))
    return M.binding_summary(rows)


@query("""WITH c AS (SELECT o_custkey % 400 AS run_id, o_orderkey AS company, CASE WHEN o_custkey % 400 % 9 > 0 THEN 2005 END AS requested, CASE WHEN o_orderkey % 6 > 0 THEN CASE WHEN o_orderkey % 11 = 0 THEN 2004 ELSE 2005 END END AS used, CASE o_orderkey % 5 WHEN 0 THEN 'assumed_from_query' WHEN 1 THEN 'upload_labeled' WHEN 2 THEN 'exact' END AS a, o_orderkey % 5 = 3 AS by_name, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) END AS e FROM orders),
s AS (SELECT *, CASE WHEN requested IS NULL THEN coalesce(a, 'not_requested') WHEN used IS NULL THEN 'not_found' WHEN a = 'assumed_from_query' THEN 'assumed' WHEN used = requested AND (by_name OR coalesce(a = 'upload_labeled', false)) THEN 'exact_upload' WHEN used = requested THEN 'exact' ELSE 'fallback' END AS status FROM c),
w AS (SELECT run_id, company, status, bool_or(status IN ('not_found', 'fallback')) OVER r AS any_mismatch, bool_or(status = 'assumed') OVER r AS any_assumed, CASE WHEN count(e) OVER r >= 2 THEN CAST(max(e) OVER r - min(e) OVER r AS INT) END AS span_days FROM s WINDOW r AS (PARTITION BY run_id))
SELECT *, coalesce(span_days >= 90, false) AS calendars_differ FROM w""")
def agg43_alignment(spark, sf_dir):
    k, run = F.col("o_orderkey"), F.col("o_custkey") % 400
    rows = table(spark, sf_dir, "orders").select(
        run.alias("run_id"),
        k.alias("company"),
        F.when(run % 9 > 0, 2005).alias("requested"),
        F.when(k % 6 > 0, F.when(k % 11 == 0, 2004).otherwise(2005)).alias("used"),
        F.when(k % 5 == 0, "assumed_from_query").when(k % 5 == 1, "upload_labeled").when(k % 5 == 2, "exact").alias("alignment"),
        F.when(k % 5 == 3, "upload_filename").alias("source"),
        F.when(k % 3 > 0, F.to_date("o_orderdate")).alias("period_end"),
    )
    return M.alignment(rows).select("run_id", "company", "status", "any_mismatch", "any_assumed", "span_days", "calendars_differ")


@query("""WITH r AS (SELECT c_custkey AS run_id, c_custkey % 10 > 0 AS rag_enabled, c_custkey % 4 AS chunks_indexed, c_custkey % 13 = 0 AS sample FROM customer),
d AS (SELECT run_id, bool_or(t = 'csv') AS csv, bool_or(t = 'excel') AS excel, bool_or(t = 'structured_json') AS json, bool_or(t = 'pdf') AS pdf, bool_or(t IN ('pdf', 'markdown')) AS narrative, array_to_string(list_sort(list(DISTINCT t)), ',') AS formats FROM (SELECT o_custkey AS run_id, ['csv', 'excel', 'structured_json', 'pdf', 'markdown', 'pdf', 'markdown', 'pdf'][o_orderkey % 8 + 1] AS t FROM orders WHERE o_orderkey % 5 = 0) GROUP BY 1),
c AS (SELECT o_custkey AS run_id, bool_or(o_orderkey % 30 = 1) AS sec, bool_or(o_orderkey % 20 = 2) AS yahoo, bool_or(o_orderkey % 25 = 3) AS hit FROM orders GROUP BY 1), s AS (SELECT o_custkey AS run_id, count(CASE WHEN o_orderkey % 40 = 4 THEN 1 END) AS ok FROM orders GROUP BY 1)
SELECT run_id, CASE WHEN csv THEN 'uploaded_csv' WHEN excel THEN 'uploaded_excel' WHEN json THEN 'uploaded_json' WHEN sample THEN 'sample_db' WHEN sec THEN 'sec_companyfacts' WHEN yahoo THEN 'yahoo_fundamentals' WHEN narrative THEN 'document_extracted' ELSE 'none' END AS structured,
  CASE WHEN NOT rag_enabled THEN 'disabled' WHEN hit THEN 'vector_hybrid' WHEN chunks_indexed > 0 THEN 'indexed_no_hits' WHEN pdf THEN 'pdf_no_index' WHEN narrative THEN 'document_no_index' ELSE 'skipped' END AS rag, coalesce(ok, 0) > 0 AS market_ok, coalesce(ok, 0) AS market_ok_count, coalesce(formats, '') AS upload_formats
FROM r LEFT JOIN d USING (run_id) LEFT JOIN c USING (run_id) LEFT JOIN s USING (run_id)""")
def agg44_run_sources(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "run_id"), F.col("o_orderkey")
    c = F.col("c_custkey")
    runs = table(spark, sf_dir, "customer").select(c.alias("run_id"), (c % 10 > 0).alias("rag_enabled"), (c % 4).alias("chunks_indexed"), (c % 13 == 0).alias("sample"))
    kinds = F.array(*map(F.lit, ("csv", "excel", "structured_json", "pdf", "markdown", "pdf", "markdown", "pdf")))
    documents = o.where("o_orderkey % 5 = 0").select("run_id", F.element_at(kinds, (k % 8 + 1).cast("int")).alias("source_type"))
    companies = o.select("run_id", F.when(k % 30 == 1, "sec_companyfacts").when(k % 20 == 2, "yahoo_fundamentals").otherwise("none").alias("structured_source"), F.when(k % 25 == 3, 2).otherwise(0).alias("n_hits"))
    return M.data_sources(runs, documents, companies, o.select("run_id", F.when(k % 40 == 4, F.col("o_totalprice")).alias("price")))


@query(f"""WITH {HITS}, h AS (SELECT query_id, count(*) AS n, arg_min(chunk_id, rank) AS best, bool_or(chunk_id % 97 = 0) AS risk FROM hits WHERE mode = 'dense' AND query_id % 6 > 0 GROUP BY 1)
SELECT s_suppkey AS run_id, s_name AS company, coalesce(n, 0) AS n_hits, best AS best_chunk, CASE WHEN s_suppkey % 4 > 0 THEN 'sec' ELSE 'none' END AS structured_source, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 5 ELSE 0 END AS n_metrics,
  CASE WHEN s_suppkey % 4 > 0 AND s_suppkey % 3 = 0 THEN 'high' WHEN coalesce(risk, false) THEN 'medium' ELSE 'low' END AS supply_level, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS price, CASE WHEN s_suppkey % 5 > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence FROM supplier LEFT JOIN h ON query_id = s_suppkey""")
def jon26_company_bundles(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    ids = (k.alias("run_id"), F.col("s_name").alias("company"))
    names = s.select(F.col("s_suppkey").alias("query_id"), F.col("s_name").alias("company"))
    h = hits(spark, sf_dir).where("mode = 'dense' and query_id % 6 > 0").join(names, "query_id").select(F.col("query_id").alias("run_id"), "company", "chunk_id", "rank", F.when(F.col("chunk_id") % 97 == 0, "risk_signal").otherwise("narrative").alias("chunk_type"))
    payload = s.where("s_suppkey % 4 > 0").select(*ids, F.lit("sec").alias("structured_source"), (k % 5).alias("n_metrics"), F.when(k % 3 == 0, "high").otherwise("").alias("supply_level"))
    return M.company_bundles(s.select(*ids), h, payload, s.where("s_suppkey % 2 = 0").select(*ids, F.col("s_acctbal").alias("price")), s.where("s_suppkey % 5 > 0").select(*ids, F.lit(0.5).alias("overall")))


@query("""SELECT s_name AS company, 'missing_metrics' AS violation FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09 AND l_quantity > 40 AND l_tax > 0.07) UNION ALL SELECT s_name, 'missing_sentiment' FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_discount < 0.01 AND l_quantity > 45 AND l_tax > 0.07)""")
def jon14_missing_results(spark, sf_dir):
    s, li = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("company")), table(spark, sf_dir, "lineitem")
    of = lambda rows: rows.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("company")
    return M.completeness(s, of(li.where("l_discount > 0.09 and l_quantity > 40 and l_tax > 0.07")), of(li.where("l_discount < 0.01 and l_quantity > 45 and l_tax > 0.07")))


@query("""WITH r AS (SELECT o_orderkey, list_filter([CASE WHEN o_orderkey % 3 > 0 THEN 'a' END, CASE WHEN o_orderkey % 4 = 0 THEN 'b' END], lambda x: x IS NOT NULL) AS q, list_filter([CASE WHEN o_orderkey % 5 > 1 THEN 'a' END, CASE WHEN o_orderkey % 7 = 0 THEN 'c' END], lambda x: x IS NOT NULL) AS u, o_orderkey % 11 = 0 AS e, ['', 'Use_Uploaded', 'ALL', 'asked'][CASE WHEN o_orderkey % 13 < 4 THEN o_orderkey % 13 ELSE 0 END + 1] AS scope FROM orders),
s AS (SELECT *, CASE WHEN e THEN 'explicit' WHEN scope = 'Use_Uploaded' THEN 'uploaded' WHEN scope = 'asked' THEN 'query' WHEN scope = 'ALL' THEN 'both' WHEN len(q) > 0 AND len(u) > 0 AND NOT list_has_all(u, q) THEN 'mismatch' WHEN len(q) > 0 THEN 'query' WHEN len(u) > 0 THEN 'uploaded' ELSE '' END AS source FROM r)
SELECT o_orderkey, source, source = 'mismatch' AS pause, array_to_string(list_sort(CASE source WHEN 'explicit' THEN ['x'] WHEN 'both' THEN list_distinct(list_concat(q, u)) WHEN 'uploaded' THEN u ELSE q END), ',') AS companies FROM s""")
def jon21_company_scope(spark, sf_dir):
    k = F.col("o_orderkey")
    some = lambda *xs: F.filter(F.array(*(F.when(ok, F.lit(n)) for ok, n in xs)), lambda x: x.isNotNull())
    scope = F.when(k % 13 == 1, "Use_Uploaded").when(k % 13 == 2, "ALL").when(k % 13 == 3, "asked")
    r = M.resolve_companies(some((k % 3 > 0, "a"), (k % 4 == 0, "b")), some((k % 5 > 1, "a"), (k % 7 == 0, "c")), F.when(k % 11 == 0, F.array(F.lit("x"))), scope)
    return table(spark, sf_dir, "orders").select("o_orderkey", r.alias("r")).select("o_orderkey", "r.source", "r.pause", F.array_join(F.array_sort("r.companies"), ",").alias("companies"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS v, CASE l_linenumber % 4 WHEN 0 THEN 'million' WHEN 1 THEN 'thousand' WHEN 2 THEN 'billion' END AS scale, CASE l_returnflag WHEN 'R' THEN 'EUR' WHEN 'A' THEN 'USD' END AS currency, CASE WHEN l_partkey % 3 = 0 THEN 'caption' WHEN l_partkey % 3 = 1 THEN 'guess' END AS src, CASE WHEN l_suppkey % 5 = 0 THEN 'quarter' END AS hint, l_suppkey % 9 = 0 AS done FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN currency = 'EUR' THEN NULL WHEN done THEN round(v, 8) WHEN scale = 'million' OR scale IS NULL AND v >= 1000 THEN round(v / 1e3, 8) WHEN scale = 'thousand' THEN round(v / 1e6, 8) ELSE round(v, 8) END AS value_billion,
  CASE WHEN coalesce(currency, 'USD') = 'USD' AND coalesce(src = 'caption', false) AND (scale IS NOT NULL OR done) AND hint IS NULL THEN 'high' ELSE 'low' END AS confidence,
  CASE WHEN currency = 'EUR' THEN coalesce(src, 'non_usd') WHEN scale IS NULL AND NOT done AND v >= 1000 THEN 'inferred_million' WHEN done THEN coalesce(src, 'pre_normalized') WHEN scale IS NULL THEN coalesce(src, 'unitless') ELSE src END AS norm_source FROM a""")
def txt26_scaled_amounts(spark, sf_dir):
    n, p = F.col("l_linenumber") % 4, F.col("l_partkey") % 3
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("value"), F.when(n == 0, "million").when(n == 1, "thousand").when(n == 2, "billion").alias("scale"), F.when(F.col("l_returnflag") == "R", "EUR").when(F.col("l_returnflag") == "A", "USD").alias("currency"),
        F.when(p == 0, "caption").when(p == 1, "guess").alias("source"), F.when(F.col("l_suppkey") % 5 == 0, "quarter").alias("period_hint"), (F.col("l_suppkey") % 9 == 0).alias("already"),
    )
    return M.normalized_amounts(rows).select("l_orderkey", "l_linenumber", "l_partkey", "value_billion", "confidence", "norm_source")


@query("""WITH q AS (SELECT conv_id, turn, lower(t) AS low, t FROM (SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN 'Compare cash and debt in FY 2024: ' WHEN 1 THEN 'Margin, only the uploaded note, Q2 2023 ' WHEN 2 THEN '供应链与估值 ' ELSE '' END || coalesce(text, '') AS t FROM conversations))
SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN regexp_matches(low, 'profit|margin|ebitda|盈利|利润|毛利|净利') THEN 'profitability' END, CASE WHEN regexp_matches(low, 'liquidity|cash|现金|流动性') THEN 'liquidity' END, CASE WHEN regexp_matches(low, 'debt|leverage|solvency|负债|偿债|杠杆') THEN 'solvency' END, CASE WHEN regexp_matches(low, 'r&d|research|研发|创新') THEN 'r_and_d' END,
  CASE WHEN regexp_matches(low, 'supply|supplier|供应链|供应商') THEN 'supply_chain' END, CASE WHEN regexp_matches(low, 'sentiment|tone|management|管理层|语气|措辞') THEN 'sentiment' END, CASE WHEN regexp_matches(low, 'compliance|audit|risk disclosure|合规|审计|披露') THEN 'compliance' END, CASE WHEN regexp_matches(low, 'market|valuation|price|行情|估值|股价') THEN 'market' END], lambda x: x IS NOT NULL), ',') AS dimensions,
  regexp_matches(low, '\\b(compare|comparison|versus|vs)\\b|对比|比较') AS wants_comparison, contains(low, 'only the uploaded') AS upload_only, nullif(regexp_extract(t, '(?i)\\b((?:FY|Q[1-4])\\s*20\\d{2}|20\\d{2})\\b', 1), '') AS time_range FROM q""")
def txt29_question_features(spark, sf_dir):
    k = F.col("conv_id") % 5
    lead = F.when(k == 0, "Compare cash and debt in FY 2024: ").when(k == 1, "Margin, only the uploaded note, Q2 2023 ").when(k == 2, "供应链与估值 ").otherwise("")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", M.query_features(F.concat(lead, F.coalesce("text", F.lit("")))).alias("f"))
    return rows.select("conv_id", "turn", F.array_join("f.dimensions", ",").alias("dimensions"), "f.wants_comparison", "f.upload_only", "f.time_range")


@query("""WITH g AS (SELECT c.conv_id, c.turn, lower(c.text) AS t, list(DISTINCT o.conv_id % 3) AS docs, list(DISTINCT (o.conv_id % 3, o.turn % 2)) AS pages FROM conversations c JOIN conversations o ON o.conv_id = c.conv_id WHERE o.turn <= c.turn GROUP BY ALL)
SELECT conv_id, turn, regexp_matches(t, '\\b(how much|what is the|amount|ratio|margin|capex|revenue|eps|million|billion|percent|%)\\b') OR turn % 3 = 0 AS numeric_extraction, regexp_matches(t, '\\b(calculate|computed?|change|delta|difference|growth|cagr|exclude|if we|driven|ratio)\\b') OR turn % 3 = 1 AS multi_step,
  regexp_matches(t, '\\b(fy\\s*20\\d{2}|fiscal|year[- ]end|as of|q[1-4]|compared to|versus|vs\\.?)\\b') AS period, regexp_matches(t, '\\b(not|never|except|excluding|no longer|without|did not|isn''t|is not)\\b') AS negation, len(pages) > 1 AS multi_page, len(docs) > 1 AS cross_document FROM g""")
def txt30_case_labels(spark, sf_dir):
    """A turn's evidence are the turns before it; every turn is a case."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    o = c.select("conv_id", F.col("turn").alias("t"), F.struct((F.col("conv_id") % 3).alias("doc"), (F.col("turn") % 2).alias("page")).alias("g"))
    gold = c.hint("merge").join(o, "conv_id").where("t <= turn").groupBy("conv_id", "turn", "text").agg(F.collect_set("g").alias("gold"))
    reasoning = F.when(F.col("turn") % 3 == 0, "Information extraction").when(F.col("turn") % 3 == 1, "Numerical reasoning")
    out = M.case_labels(gold.select(F.struct("conv_id", "turn").alias("case_id"), F.col("text").alias("question"), reasoning.alias("reasoning"), "gold"))
    return out.select("case_id.*", *out.columns[1:])


@query("""WITH r AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Data sources: filings.' || chr(10) || '**Disclaimer**: none' WHEN 1 THEN 'This does not constitute investment advice.' WHEN 2 THEN 'Uploaded document: x' ELSE '  ' END AS t, page_id % 4 AS k FROM pages)
SELECT page_id, 'missing_risk_disclaimer' AS code, 'high' AS severity FROM r WHERE k = 2 UNION ALL SELECT page_id, 'missing_data_provenance', 'medium' FROM r WHERE k = 1""")
def txt36_report_violations(spark, sf_dir):
    k = F.col("page_id") % 4
    text = F.when(k == 0, "Data sources: filings.\n**Disclaimer**: none").when(k == 1, "This does not constitute investment advice.").when(k == 2, "Uploaded document: x").otherwise("  ")
    return M.report_violations(table(spark, sf_dir, "pages").select("page_id", text.alias("text")), "text", "page_id")


@query("""WITH r AS (SELECT o_custkey % 50 AS run_id, CASE o_orderkey % 6 WHEN 0 THEN 'ready' WHEN 1 THEN 'skipped_duplicate' WHEN 2 THEN 'failed' WHEN 3 THEN 'pending' WHEN 4 THEN 'indexing' ELSE 'ready' END AS status, o_orderkey % 17 AS n, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 3 END AS e FROM orders)
SELECT run_id, CAST(coalesce(sum(CASE WHEN status IN ('ready', 'skipped_duplicate') THEN n END), 0) AS BIGINT) AS chunks_indexed, count(CASE WHEN status IN ('ready', 'skipped_duplicate') THEN 1 END) AS documents_indexed, count(CASE WHEN status = 'failed' THEN 1 END) AS documents_failed,
  count(CASE WHEN status IN ('pending', 'indexing') THEN 1 END) AS documents_pending, CAST(coalesce(sum(e), 0) AS BIGINT) AS embed_calls FROM r GROUP BY 1""")
def agg22_receipt_summary(spark, sf_dir):
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("ready", "skipped_duplicate", "failed", "pending", "indexing", "ready"))), (k % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("run_id"), status.alias("status"), (k % 17).alias("chunk_count"), F.when(k % 4 > 0, k % 3).alias("embed_calls"))
    return M.receipt_summary(rows, "run_id")


@query("""WITH s AS (SELECT c_nationkey AS run_id, CASE c_custkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'cached' WHEN 2 THEN 'failed' END AS status, CASE WHEN c_custkey % 40 > 0 AND (c_nationkey > 5 OR c_custkey % 5 <> 2) OR c_nationkey = 3 THEN c_acctbal END AS price FROM customer WHERE c_nationkey > 3 OR c_custkey % 5 <> 2)
SELECT run_id, count(CASE WHEN price IS NOT NULL AND coalesce(status, 'ok') <> 'failed' THEN 1 END) AS ok_count, count(*) AS total_count, bool_and(price IS NOT NULL AND coalesce(status, 'ok') <> 'failed') AS all_ok, count(CASE WHEN status = 'cached' THEN 1 END) AS from_cache FROM s GROUP BY 1""")
def agg23_snapshot_totals(spark, sf_dir):
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    rows = table(spark, sf_dir, "customer").where((n > 3) | (c % 5 != 2))
    priced = ((c % 40 > 0) & ((n > 5) | (c % 5 != 2))) | (n == 3)
    status = F.when(c % 5 == 0, "ok").when(c % 5 == 1, "cached").when(c % 5 == 2, "failed")
    return M.snapshot_summary(rows.select(n.cast("long").alias("run_id"), status.alias("status"), F.when(priced, F.col("c_acctbal")).alias("price"), (c % 5 == 1).alias("from_cache")), "run_id")


UNIVERSE = """dir AS (SELECT 'TK' || chr(CAST(65 + s_suppkey % 26 AS INT)) || chr(CAST(65 + s_suppkey // 26 % 26 AS INT)) || chr(CAST(65 + s_suppkey // 676 % 26 AS INT)) AS ticker, s_name AS title FROM supplier),
q AS (SELECT o_orderkey AS query_id, CASE o_orderkey % 3 WHEN 0 THEN 'supplier#' || lpad(CAST(o_custkey % 100 AS VARCHAR), 9, '0') WHEN 1 THEN 'Nobody' END AS company, 'TK' || chr(CAST(65 + o_custkey % 26 AS INT)) || chr(CAST(65 + o_orderkey % 4 AS INT)) || 'A' AS t FROM orders)"""


@query(f"""WITH {UNIVERSE}, n AS (SELECT query_id, company, d.ticker, CASE WHEN d.ticker IS NULL THEN 'unresolved' ELSE 'curated' END AS method FROM q LEFT JOIN dir d ON lower(d.title) = lower(company) WHERE company IS NOT NULL),
m AS (SELECT query_id, title, t FROM q JOIN (SELECT ticker, min(title) AS title FROM dir GROUP BY 1) d ON d.ticker = t WHERE t <> 'TKAAA' AND (query_id, t) NOT IN (SELECT (query_id, ticker) FROM n WHERE ticker IS NOT NULL))
SELECT query_id, company, ticker, method FROM n UNION ALL SELECT query_id, title, t, 'query_token' FROM m""")
def jon10_universe(spark, sf_dir):
    from quarry.operators.entities import company_universe

    letter = lambda n: F.chr((65 + n % 26).cast("int"))
    k = F.col("s_suppkey")
    directory = table(spark, sf_dir, "supplier").select(F.concat(F.lit("TK"), letter(k), letter(F.floor(k / 26)), letter(F.floor(k / 676))).alias("ticker"), F.col("s_name").alias("title"), F.lower("s_name").alias("normalized"))
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.when(o % 3 == 0, F.concat(F.lit("supplier#"), F.lpad((c % 100).cast("string"), 9, "0"))).when(o % 3 == 1, "Nobody")
    text = F.concat(F.lit("Compare TKAAA, "), F.concat(F.lit("TK"), letter(c), letter(o % 4), F.lit("A")), F.lit(" and FY for the CEO's TKTOOLONG"))
    queries = table(spark, sf_dir, "orders").select(o.alias("query_id"), text.alias("text"), F.when(name.isNotNull(), F.array(name)).otherwise(F.array().cast("array<string>")).alias("companies"))
    stop = spark.createDataFrame([("TKAAA",), ("FY",), ("CEO",)], "word string")
    return company_universe(queries, directory, stop)


@query("""WITH p AS (SELECT page_id, CASE WHEN page_id % 31 = 0 THEN '' WHEN page_id % 10 = 4 THEN 'd' || page_id - 4 ELSE 'd' || page_id END AS document_id, CASE WHEN page_id % 3 = 0 THEN 'c' || page_id % 7 END AS issuer, ['c' || page_id % 5, 'c' || page_id % 9] AS detected FROM pages),
k AS (SELECT * FROM p WHERE CASE WHEN issuer IS NOT NULL THEN issuer IN ('c1', 'c2') ELSE list_has_any(detected, ['c1', 'c2']) END), n AS (SELECT *, count(*) OVER (PARTITION BY document_id) AS n FROM k)
SELECT page_id, CASE WHEN document_id = '' THEN 'missing_id' WHEN n > 1 THEN 'duplicate_id' ELSE 'ok' END AS reason FROM n""")
def jon16_company_pages(spark, sf_dir):
    from quarry.operators.entities import company_pages

    k = F.col("page_id")
    name = lambda lead, n: F.concat(F.lit(lead), n.cast("string"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.when(k % 31 == 0, "").when(k % 10 == 4, name("d", k - 4)).otherwise(name("d", k)).alias("document_id"), F.when(k % 3 == 0, F.array(name("c", k % 7))).alias("issuers"), F.array(name("c", k % 5), name("c", k % 9)).alias("detected"))
    good, bad = company_pages(rows, spark.createDataFrame([("c1",), ("c2",)], "company string"))
    return good.select("page_id", F.lit("ok").alias("reason")).unionByName(bad.select("page_id", "reason"))


@query("""WITH r AS (SELECT o_orderkey AS case_id, 'doc' || o_custkey AS doc_name, 'doc' || (o_custkey + o_orderkey % 3) AS other FROM orders), n AS (SELECT case_id, doc_name FROM r UNION SELECT case_id, other FROM r WHERE case_id % 4 > 0)
SELECT doc_name, count(DISTINCT case_id) AS n_questions FROM n WHERE doc_name NOT IN (SELECT 'doc' || c_custkey FROM customer WHERE c_custkey % 9 > 0) GROUP BY 1""")
def jon13_referenced_documents(spark, sf_dir):
    from quarry.operators.entities import missing_documents

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = lambda n: F.concat(F.lit("doc"), n.cast("string"))
    questions = table(spark, sf_dir, "orders").select(k.alias("case_id"), name(c).alias("doc_name"), F.when(k % 4 > 0, F.array(F.struct(name(c + k % 3).alias("doc")))).alias("evidence"))
    registry = table(spark, sf_dir, "customer").where("c_custkey % 9 > 0").select(name(F.col("c_custkey")).alias("doc_name"))
    return missing_documents(questions, registry)
