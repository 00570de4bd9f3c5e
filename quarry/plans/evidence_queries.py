"""Queries of keyword scores with facts, retrieval modes, periods, claims of all types and their exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import claim_building as B
from quarry.operators import periods as P
from quarry.operators import retrieval as R
from quarry.plans.registry import query
from quarry.plans.standins import FACTS, HITS, facts, hits
from quarry.plans.text_queries import BM25, QUESTIONS, SYN, WORDS, closed_sql, docs, questions
from quarry.session import table

# Parts stand for chunks with facts, and one question a part type for queries.
CHUNKS = """chunks AS (SELECT p_partkey AS chunk_id, p_name || ' ' || lower(p_type) || CASE p_partkey % 5 WHEN 0 THEN ' total revenue and margin' WHEN 1 THEN ' debt' WHEN 2 THEN ' supply chain risk' ELSE '' END AS text,
  CASE p_partkey % 4 WHEN 0 THEN 'revenue' WHEN 1 THEN 'debt' WHEN 2 THEN 'free_cash' END AS metric, CASE WHEN p_size % 3 > 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS value,
  CASE p_size % 3 WHEN 0 THEN 'consolidated' WHEN 1 THEN 'Segment' ELSE '' END AS scope, CASE WHEN p_size % 2 = 0 THEN 'Total sales' ELSE 'sales' END AS row_label, CASE WHEN p_size % 5 = 0 THEN 'html_table' ELSE 'text' END AS source FROM part)"""
ASKED = """asked AS (SELECT row_number() OVER (ORDER BY p_type) AS query_id, CASE row_number() OVER (ORDER BY p_type) % 4 WHEN 0 THEN 'net sales of ' WHEN 1 THEN 'debt and risk of ' WHEN 2 THEN 'free cash margin of ' ELSE 'story of ' END || lower(p_type) AS text FROM (SELECT DISTINCT p_type FROM part))"""


def _chunks(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    tail = F.when(k % 5 == 0, " total revenue and margin").when(k % 5 == 1, " debt").when(k % 5 == 2, " supply chain risk").otherwise("")
    metric = F.when(k % 4 == 0, "revenue").when(k % 4 == 1, "debt").when(k % 4 == 2, "free_cash")
    fact = F.struct(
        metric.alias("metric"),
        F.when(size % 3 > 0, size.cast("string")).otherwise("").alias("value"),
        F.when(size % 3 == 0, "consolidated").when(size % 3 == 1, "Segment").otherwise("").alias("scope"),
        F.when(size % 2 == 0, "Total sales").otherwise("sales").alias("row_label"),
        F.when(size % 5 == 0, "html_table").otherwise("text").alias("source"),
    )
    return table(spark, sf_dir, "part").select(k.alias("chunk_id"), F.concat("p_name", F.lit(" "), F.lower("p_type"), tail).alias("text"), F.when(metric.isNotNull(), fact).alias("fact"))


def _asked(spark, sf_dir):
    from pyspark.sql import Window

    types = table(spark, sf_dir, "part").select("p_type").distinct().withColumn("query_id", F.row_number().over(Window.orderBy("p_type")).cast("long"))  # part types are few
    m = F.col("query_id") % 4
    lead = F.when(m == 0, "net sales of ").when(m == 1, "debt and risk of ").when(m == 2, "free cash margin of ").otherwise("story of ")
    return types.select("query_id", F.concat(lead, F.lower("p_type")).alias("text"))


@query(f"""WITH {CHUNKS}, {ASKED}, {SYN}, c_ AS (SELECT chunk_id, replace(text, 'supply chain', 'supply_chain') AS text FROM chunks), {closed_sql("qs", "asked", "query_id")}, {closed_sql("cs", "c_", "chunk_id")},
q AS (SELECT id AS query_id, id % 4 AS m, w FROM qs), c AS (SELECT chunks.*, w AS cw, CASE WHEN contains(text, 'supply chain risk') THEN 'risk_signal' WHEN contains(text, 'revenue and margin') THEN 'financial_metric' ELSE 'narrative' END AS kind FROM chunks JOIN cs ON cs.id = chunk_id),
p AS (SELECT query_id, m, chunk_id, kind, metric, value, scope, row_label, source, len(list_intersect(w, cw)) AS common, len(list_intersect(w, cw)) / len(w) AS o, list_has_any(w, {list(T.METRIC_WORDS)}) AS metric_asked, list_has_any(w, {list(T.RISK_WORDS)}) AS risk_asked,
  coalesce(CASE WHEN m = 0 THEN metric = 'revenue' WHEN m = 1 THEN metric = 'debt' WHEN m = 2 THEN metric = 'free_cash' ELSE false END, false) AS right_one FROM q, c),
r AS (SELECT *, o + CASE WHEN kind = 'financial_metric' AND metric_asked THEN 0.15 ELSE 0.0 END AS x, CASE WHEN kind = 'risk_signal' AND risk_asked THEN 0.15 ELSE 0.0 END AS y,
  0.4 + CASE WHEN value <> '' THEN 0.1 ELSE 0.0 END + CASE lower(scope) WHEN 'consolidated' THEN 0.22 WHEN 'segment' THEN 0.02 ELSE 0.0 END + CASE WHEN contains(lower(row_label), 'total') THEN 0.08 ELSE 0.0 END + CASE WHEN source = 'html_table' THEN 0.05 ELSE 0.0 END AS reward
  FROM p WHERE common > 0 OR right_one)
SELECT query_id, chunk_id, round(least(1.0, CASE WHEN m = 3 OR metric IS NULL THEN x WHEN right_one THEN greatest(x, 0.55) + reward ELSE x * 0.35 END + y), 4) AS score FROM r""")
def txt03_keyword_score(spark, sf_dir):
    return R.keyword_scores(_asked(spark, sf_dir), _chunks(spark, sf_dir))


@query(BM25.replace("rank <= 10)", "rank <= 20)") + f""", v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), ds AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(q.e, v.e), 4) AS score FROM v q JOIN questions ON q.vec_id = questions.query_id, v),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds) WHERE rank <= 20),
b AS (SELECT query_id, doc_id, score, rank, 'bm25' AS m FROM hits UNION ALL SELECT query_id, doc_id, score, rank, 'dense' FROM dense),
f AS (SELECT d, query_id, doc_id, round(sum(CASE m WHEN 'dense' THEN 1.0 ELSE 1.1 END / (60 + rank)), 6) AS score, min(CASE m WHEN 'dense' THEN 0 ELSE 100000 END + rank) AS seen FROM b JOIN (VALUES (10), (20)) t(d) ON rank <= d GROUP BY 1, 2, 3),
g AS (SELECT *, row_number() OVER (PARTITION BY d, query_id ORDER BY score DESC, seen) AS rank FROM f), pool AS (SELECT * FROM g WHERE d = 20 AND rank <= 20),
{SYN}, pd AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM pool)), {closed_sql("qs", "questions", "query_id")}, {closed_sql("pds", "pd", "doc_id")},
t AS (SELECT pool.query_id, pool.doc_id, rank, score, pds.w AS dw, qs.w AS qw FROM pool JOIN pds ON pds.id = pool.doc_id JOIN qs ON qs.id = pool.query_id),
rr AS (SELECT query_id, doc_id, rank, round(least(1.0, (len(list_intersect(qw, dw)) / len(qw) + 0.03) * 0.85 + least(1.0, score) * 0.15) + 1e-9, 4) AS rerank_score FROM t)
SELECT m AS mode, query_id, rank, doc_id, score FROM b WHERE rank <= 10 UNION ALL SELECT 'hybrid', query_id, rank, doc_id, score FROM g WHERE d = 10 AND rank <= 10
UNION ALL SELECT * FROM (SELECT 'hybrid_rerank', query_id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS rank, doc_id, rerank_score FROM rr) WHERE rank <= 10""")
def txt10_retrieval_modes(spark, sf_dir):
    """Vectors stand for the documents, and the passages, of their number."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = questions(spark, sf_dir).hint("merge").join(v.withColumnRenamed("doc_id", "query_id"), "query_id")
    return R.retrieve(R.MODES, q, docs(spark, sf_dir), v, 10, 20, {"dense": 1.0, "bm25": 1.1})


@query(f"""WITH {QUESTIONS}, sc AS (SELECT doc_id, source AS scope FROM documents UNION SELECT doc_id, 'lang-' || lang FROM documents), qsc AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN 'lang-fr' ELSE 'src' || item_id % 20 END AS scope FROM benchmark),
lengths AS (SELECT doc_id, {WORDS} AS w FROM documents), stats AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean FROM lengths),
post AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM lengths) GROUP BY 1, 2, 3),
terms AS (SELECT query_id, unnest(list_distinct({WORDS})) AS term FROM questions), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1), own AS (SELECT query_id, doc_id FROM qsc JOIN sc USING (scope)),
b AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 4) AS score FROM own JOIN terms USING (query_id) JOIN post USING (term, doc_id) JOIN df USING (term), stats GROUP BY 1, 2),
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT query_id, doc_id, round(list_cosine_similarity(q.e, x.e), 4) AS score FROM own JOIN v q ON q.vec_id = query_id JOIN v x ON x.vec_id = doc_id),
r AS (SELECT 'bm25' AS mode, query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b JOIN (SELECT vec_id AS query_id FROM v) USING (query_id) UNION ALL SELECT 'dense', query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) FROM d),
f AS (SELECT query_id, doc_id, round(sum(CASE mode WHEN 'dense' THEN 1.0 ELSE 1.1 END / (60 + rank)), 6) AS score, min(CASE mode WHEN 'dense' THEN 0 ELSE 100000 END + rank) AS seen FROM r WHERE rank <= 10 GROUP BY 1, 2)
SELECT mode, query_id, rank, doc_id, score FROM r WHERE rank <= 10 UNION ALL SELECT * FROM (SELECT 'hybrid', query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rank, doc_id, score FROM f) WHERE rank <= 10""")
def txt10_scoped_modes(spark, sf_dir):
    """Sources and languages stand for companies; a question is asked of one of them."""
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    own = d.select("doc_id", F.explode(F.array("source", F.concat(F.lit("lang-"), "lang"))).alias("scope"))
    asked = b.select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 3 == 0, "lang-fr").otherwise(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))).alias("scope"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = questions(spark, sf_dir).hint("merge").join(v.withColumnRenamed("doc_id", "query_id"), "query_id")
    return R.retrieve(("bm25", "dense", "hybrid"), q, docs(spark, sf_dir), v, 10, scopes=(asked, own))


@query(f"""WITH {HITS}, h AS (SELECT query_id, CASE WHEN rank = 7 AND query_id % 3 = 0 THEN NULL ELSE chunk_id END AS chunk_id, doc, CASE WHEN rank = 9 AND query_id % 7 = 0 THEN 'other' ELSE 'c' || query_id END AS company, mode FROM hits WHERE rank <= CASE WHEN query_id % 11 = 0 THEN 12 ELSE 10 END AND mode = 'bm25' AND query_id % 13 <> 0),
g AS (SELECT s_suppkey AS query_id, count(h.query_id) AS n, count(CASE WHEN h.query_id IS NOT NULL AND chunk_id IS NULL THEN 1 END) AS blank, count(CASE WHEN h.query_id IS NOT NULL AND CAST(substr(doc, 2) AS INT) % 50 = 1 THEN 1 END) AS outside, count(CASE WHEN company = 'other' THEN 1 END) AS foreign_ FROM supplier LEFT JOIN h ON h.query_id = s_suppkey GROUP BY 1)
SELECT query_id, CASE WHEN n = 0 THEN 'no_candidates' WHEN n > 10 THEN 'too_many' WHEN blank > 0 THEN 'missing_or_duplicate_chunk' WHEN outside > 0 THEN 'outside_corpus' WHEN foreign_ > 0 THEN 'cross_company' ELSE 'ok' END AS reason FROM g""")
def txt32_validate_candidates(spark, sf_dir):
    q, rank = F.col("query_id"), F.col("rank")
    own = F.concat(F.lit("c"), q.cast("string"))
    h = hits(spark, sf_dir).where((F.col("mode") == "bm25") & (q % 13 != 0) & (rank <= F.when(q % 11 == 0, 12).otherwise(10)))
    h = h.select("query_id", F.when((rank == 7) & (q % 3 == 0), None).otherwise(F.col("chunk_id")).alias("chunk_id"), F.col("doc").alias("doc_id"), F.array(F.when((rank == 9) & (q % 7 == 0), "other").otherwise(own)).alias("companies"))
    corpus = hits(spark, sf_dir).where(F.substring("doc", 2, 9).cast("int") % 50 != 1).select(F.col("doc").alias("doc_id"))
    cases = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("company"))
    return R.candidate_faults(h, corpus, cases, 10)


@query(f"""WITH {HITS}, pool AS (SELECT query_id, chunk_id, rank FROM hits WHERE mode = 'dense' AND rank <= 20), f AS (
  SELECT query_id, CASE WHEN rank = 3 AND query_id % 4 = 0 THEN -1 ELSE chunk_id END AS chunk_id FROM pool WHERE rank <= CASE WHEN query_id % 5 = 0 THEN 6 ELSE 5 END AND query_id % 6 <> 0 UNION ALL SELECT query_id, chunk_id FROM pool WHERE rank = 1 AND query_id % 7 = 1 AND query_id % 5 > 0 AND query_id % 6 <> 0),
g AS (SELECT p.query_id, coalesce(max(n), 0) AS n, max(ids) AS ids, max(outside) AS outside FROM pool p LEFT JOIN (SELECT query_id, count(*) AS n, count(DISTINCT chunk_id) AS ids, count(CASE WHEN chunk_id = -1 THEN 1 END) AS outside FROM f GROUP BY 1) USING (query_id) GROUP BY 1)
SELECT query_id, CASE WHEN n = 0 THEN 'no_hits' WHEN n > 6 THEN 'too_many' WHEN outside > 0 THEN 'outside_pool' WHEN ids < n THEN 'duplicate_chunk' ELSE 'ok' END AS reason FROM g""")
def txt32_validate_reranked(spark, sf_dir):
    q, rank = F.col("query_id"), F.col("rank")
    pool = hits(spark, sf_dir).where((F.col("mode") == "dense") & (rank <= 20)).select("query_id", "chunk_id", "rank")
    top = pool.where((rank <= F.when(q % 5 == 0, 6).otherwise(5)) & (q % 6 != 0)).select("query_id", F.when((rank == 3) & (q % 4 == 0), -1).otherwise(F.col("chunk_id")).alias("chunk_id"))
    again = pool.where((rank == 1) & (q % 7 == 1) & (q % 5 > 0) & (q % 6 != 0)).select("query_id", "chunk_id")
    return R.rerank_faults(top.unionByName(again), pool, 6)


@query(f"""WITH {QUESTIONS}, p AS (SELECT doc_id, i - 1 AS paragraph, ps[i] AS text FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n{{2,}}'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 0) AS ps FROM documents), range(1, 4000) t(i) WHERE i <= len(ps)),
q AS (SELECT query_id, list_distinct({WORDS}) AS w FROM questions), s AS (SELECT query_id, doc_id, paragraph, round(count(*) / max(n), 4) AS score FROM (SELECT query_id, len(w) AS n, unnest(w) AS token FROM q) JOIN (SELECT doc_id, paragraph, unnest(list_distinct({WORDS})) AS token FROM p) USING (token) GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, paragraph) AS rank FROM s)
SELECT query_id, doc_id, paragraph, score, substr(text, 1, 400) AS snippet, rank FROM b JOIN p USING (doc_id, paragraph) WHERE rank <= 5""")
def txt33_paragraph_scores(spark, sf_dir):
    return R.paragraph_search(questions(spark, sf_dir), docs(spark, sf_dir)).withColumn("paragraph", F.col("paragraph").cast("long"))


PERIODS = """p AS (SELECT o_orderkey, o_custkey, year(o_orderdate) + 10 AS y, o_orderkey % 5 AS c, o_custkey % 4 AS e, (o_orderkey // 7) % 3 AS t FROM orders)"""


def _periods(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    y, c, e, t = F.year("o_orderdate") + 10, F.col("o_orderkey") % 5, F.col("o_custkey") % 4, F.floor(F.col("o_orderkey") / 7) % 3
    fy = lambda n=0: F.concat(F.lit("FY"), (y + n).cast("string"))
    quarter = F.concat(F.lit("Q2 "), y.cast("string"))
    claim = F.when(c == 0, fy()).when(c == 1, quarter).when(c == 2, F.concat(y.cast("string"), F.lit("-03-31"))).when(c == 3, "annual")
    evidence = F.when(e == 0, fy()).when(e == 1, quarter).when(e == 2, "latest").otherwise(fy(1))
    text = F.when(t == 1, F.concat(F.lit("in "), fy(), F.lit(" it rose"))).when(t == 2, F.concat(F.lit("in "), fy(-1), F.lit(" and "), fy())).otherwise("")
    return o.select("o_orderkey", "o_custkey", claim.alias("claim"), evidence.alias("evidence"), text.alias("text"), y.alias("y"))


@query(f"""WITH {PERIODS} SELECT o_orderkey, s AS status, s IN ('not_required', 'text_match', 'exact') AS matched FROM (SELECT o_orderkey, CASE WHEN c IN (3, 4) THEN 'not_required' WHEN t = 2 THEN 'mismatch' WHEN t = 1 THEN CASE WHEN c = 0 THEN 'text_match' ELSE 'mismatch' END
  WHEN e = 2 THEN 'unknown' WHEN c = e THEN 'exact' ELSE 'mismatch' END AS s FROM p)""")
def fun04_match_period(spark, sf_dir):
    m = P.match(F.col("claim"), F.col("evidence"), F.col("text"))
    return _periods(spark, sf_dir).select("o_orderkey", m.alias("m")).select("o_orderkey", "m.status", "m.matched")


@query(f"""WITH {PERIODS}, n AS (SELECT *, o_orderkey % 3 AS k FROM p) SELECT o_orderkey, CASE k WHEN 0 THEN 'FY' || y WHEN 1 THEN 'FY' || y || '|FY' || (y - 1) ELSE '' END AS labels,
  CASE WHEN k = 1 THEN 'ambiguous' WHEN k = 2 THEN CASE WHEN c IN (3, 4) THEN 'not_required' WHEN e = 2 THEN 'unknown' WHEN c = e THEN 'exact' ELSE 'mismatch' END WHEN e IN (1, 3) THEN 'metadata_conflict' WHEN c = 0 THEN 'text_match' ELSE 'mismatch' END AS status FROM n""")
def fun04_nearest_period(spark, sf_dir):
    """A number in a sentence with one label, between two labels at equal distances, or with labels in
    other sentences alone."""
    rows, k = _periods(spark, sf_dir), F.col("o_orderkey") % 3
    fy, before = F.concat(F.lit("FY"), F.col("y").cast("string")), F.concat(F.lit("FY"), (F.col("y") - 1).cast("string"))
    text = F.when(k == 0, F.concat(F.lit("Of "), before, F.lit(" nothing. It was 12.5 in "), fy, F.lit("; then "), before)).when(k == 1, F.concat(fy, F.lit(" 12.5 "), before)).otherwise(F.concat(F.lit("In "), fy, F.lit(". It was 12.5; then "), before))
    rows = rows.withColumn("text", text).withColumn("first", F.instr("text", "12.5") - 1)
    near = P.nearest_labels(rows.select(F.col("o_orderkey").alias("id"), "text", "first", (F.col("first") + 4).alias("last")))
    out = rows.select(F.col("o_orderkey").alias("id"), "claim", "evidence").hint("merge").join(near, "id")
    return out.select(F.col("id").alias("o_orderkey"), F.array_join("labels", "|").alias("labels"), P.match_near(F.col("claim"), F.col("labels"), F.col("evidence"))["status"].alias("status"))


@query(f"""WITH {PERIODS} SELECT o_orderkey, c IN (0, 1, 2) AND e = 1 AND t = 0 AS factual FROM p""")
def fun04_factual_period(spark, sf_dir):
    rows = _periods(spark, sf_dir)
    source = F.when(F.col("evidence").startswith("Q2"), " SEC_CompanyFacts").otherwise("query_assumption")
    alignment = F.when(F.col("text") == "", "exact").otherwise("fallback_latest")
    return rows.select("o_orderkey", P.factual(F.col("claim"), source, alignment).alias("factual"))


@query(f"""WITH {PERIODS}, f AS (SELECT o_orderkey, CASE WHEN c = 0 THEN y + 1 END AS meta, CASE WHEN e = 0 THEN y ELSE NULL END AS name_year, CASE WHEN t = 2 THEN y WHEN t = 1 THEN y END AS text_year, CASE WHEN o_custkey % 3 > 0 THEN y END AS asked FROM p),
g AS (SELECT *, coalesce(meta, name_year, text_year) AS found, CASE WHEN meta IS NOT NULL THEN NULL WHEN name_year IS NOT NULL THEN 'upload_filename' WHEN text_year IS NOT NULL THEN 'upload_text' WHEN asked IS NOT NULL THEN 'query' END AS source FROM f)
SELECT o_orderkey, CAST(coalesce(found, asked) AS INT) AS fiscal_year, source, CASE WHEN found IS NULL THEN CASE WHEN asked IS NULL THEN 'unspecified' ELSE 'assumed_from_query' END WHEN asked IS NULL THEN CASE WHEN meta IS NOT NULL THEN 'upload_labeled' ELSE source END WHEN found = asked THEN 'exact' ELSE 'fallback_latest' END AS alignment FROM g""")
def fun09_fiscal_year(spark, sf_dir):
    rows = _periods(spark, sf_dir)
    y = F.col("y").cast("string")
    meta = F.when(F.col("o_orderkey") % 5 == 0, F.col("y") + 1)
    name = F.when(F.col("o_custkey") % 4 == 0, F.concat(F.lit("up/2001/acme_fy"), y, F.lit("_10k.pdf"))).otherwise("up/2001/acme.pdf")
    asked = F.when(F.col("o_custkey") % 3 > 0, P.requested_year(F.lit(None).cast("string"), F.concat(F.lit("compare 1999 and "), y)))
    return rows.select("o_orderkey", P.annotate_year(meta, name, F.col("text"), asked).alias("a")).select("o_orderkey", "a.fiscal_year", "a.source", "a.alignment")


@query(f"""WITH {PERIODS} SELECT o_orderkey, CAST(y AS INT) AS used_year, CASE WHEN e < 2 AND t = 1 THEN y || '-09-30' WHEN e < 2 AND t = 2 THEN y || '-06-30' END AS period_end FROM p""")
def flt18_period_end(spark, sf_dir):
    rows = _periods(spark, sf_dir)
    y, e, t = F.col("y").cast("string"), F.col("o_custkey") % 4, F.floor(F.col("o_orderkey") / 7) % 3
    source = F.when(e == 0, "sec_companyfacts").when(e == 1, "my_filing_store").when(e == 2, P.CONVENTION)
    end, period = F.when(t == 1, F.concat(F.lit("ended "), y, F.lit("/09/30"))), F.concat(F.lit("year "), y, F.when(t == 2, "-06-30").otherwise(""))
    return rows.select("o_orderkey", P.used_year(F.when(e == 0, y), F.lit("n/a"), period).alias("used_year"), P.period_end(source, end, period).alias("period_end"))


# Suppliers stand for companies; what a company lacks goes by its number.
RUN = FACTS + """, w AS (SELECT company, max(CASE WHEN metric = 'revenue' AND fy = 1995 THEN value END) AS revenue, max(CASE WHEN metric = 'ebitda' AND fy = 1995 THEN value END) AS ebitda, max(CASE WHEN metric = 'operating_income' AND fy = 1995 THEN value END) AS operating_income, max(CASE WHEN metric = 'revenue' AND fy = 1994 THEN value END) AS prior FROM facts GROUP BY 1),
co AS (SELECT s_suppkey AS k, s_name AS company, s_acctbal, revenue, CASE WHEN s_suppkey % 10 <> 3 THEN ebitda END AS ebitda, operating_income, prior, s_suppkey % 11 = 0 OR s_suppkey % 7 = 0 OR revenue IS NULL AS blocked, ['low', 'HIGH', 'medium', 'unknown'][s_suppkey % 4 + 1] AS level FROM supplier LEFT JOIN w ON w.company = s_name),
bound AS (SELECT *, NOT blocked AND k % 5 <> 4 AS fits, k % 2 = 0 AS has_risk, k % 3 = 0 AS has_supply, k % 6 = 1 AS has_page, k % 3 > 0 AS has_market FROM co),
ratios AS (SELECT k, company, 'ebitda_margin' AS metric, round(ebitda / revenue, 6) AS value FROM bound WHERE NOT blocked AND ebitda IS NOT NULL UNION ALL SELECT k, company, 'operating_margin', round(operating_income / revenue, 6) FROM bound WHERE NOT blocked AND operating_income IS NOT NULL),
dims AS (SELECT k, company, d, (k * place % 100) / 10.0 AS score, has_risk, has_market FROM bound, (VALUES ('financial_risk', 3), ('market_risk', 7), ('operational_risk', 9)) t(d, place) WHERE NOT blocked AND k % 5 > 0),
claims AS (
  SELECT 'cl_num_' || company || '_' || metric AS claim_id, company AS entity, 'numeric' AS claim_type, metric AS metric_name, value, NULL AS label, k % 5 <> 4 AS good, 'unbound_input' AS no FROM ratios
  UNION ALL SELECT 'cl_abs_' || company || '_' || m, company, 'numeric', m, v, NULL, fits, 'no_matching_field' FROM (SELECT company, fits, 'revenue' AS m, revenue AS v FROM bound WHERE NOT blocked UNION ALL SELECT company, fits, 'ebitda', ebitda FROM bound WHERE NOT blocked UNION ALL SELECT company, fits, 'operating_income', operating_income FROM bound WHERE NOT blocked) WHERE v IS NOT NULL
  UNION ALL SELECT 'cl_num_' || company || '_pe_ratio', company, 'numeric', 'pe_ratio', 10 + k % 40 + 0.25, NULL, has_market AND k % 3 = 1, 'no_market_evidence' FROM bound WHERE NOT blocked AND k % 4 > 0
  UNION ALL SELECT 'cl_num_' || company || '_blocked', company, 'numeric', 'numeric_blocked', NULL, NULL, false, 'no_computable_fundamentals' FROM bound WHERE blocked
  UNION ALL SELECT 'cl_growth_' || company || '_revenue', company, 'growth', 'revenue_growth', CASE WHEN NOT blocked THEN round(revenue / prior - 1, 6) END, NULL, fits, CASE WHEN blocked THEN 'no_computable_fundamentals' ELSE 'unbound_period' END FROM bound WHERE blocked OR prior IS NOT NULL
  UNION ALL SELECT 'cl_risk_' || company || '_supply', company, 'risk_conclusion', CASE WHEN blocked THEN 'data_limitation_risk' ELSE 'supply_chain_risk' END, NULL, CASE WHEN blocked THEN 'elevated' ELSE lower(level) END, blocked OR level <> 'unknown' AND (has_page OR has_supply OR has_risk), CASE WHEN level = 'unknown' THEN 'unknown_level' ELSE 'no_risk_evidence' END FROM bound
  UNION ALL SELECT 'cl_risk_' || company || '_' || d, company, 'risk_conclusion', d, score, CASE WHEN score < 3.5 THEN 'Low' WHEN score < 6.5 THEN 'Moderate' ELSE 'Elevated' END, has_risk OR d = 'market_risk' AND has_market, 'no_screening_evidence' FROM dims)"""


def _run(spark, sf_dir):
    """(companies, fundamentals, ratios, snapshots, scores, evidence)"""
    from quarry.operators.finance import wide

    names = ("revenue", "ebitda", "operating_income")
    f = facts(spark, sf_dir)
    now = wide(f.where("fy = 1995"), names, ("company",))
    prior = f.where("fy = 1994 and metric = 'revenue'").select("company", F.col("value").alias("prior"))
    k = F.col("k")
    co = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("company")).join(now, "company", "left").join(prior, "company", "left").withColumn("ebitda", F.when(k % 10 != 3, F.col("ebitda")))
    companies = co.select("company", F.lit("FY1995").alias("period"), (k % 11 == 0).alias("fatal_gap"), F.when(k % 7 == 0, "none").otherwise("sec").alias("structured_source"), F.col("revenue").isNotNull().alias("computable"), F.element_at(F.array(*map(F.lit, ("low", "HIGH", "medium", "unknown"))), (k % 4 + 1).cast("int")).alias("risk_level"))
    fundamentals = co.unpivot(["company", "k", "prior"], list(names), "metric", "value").where("value is not null").select("company", "metric", "value", F.when(F.col("metric") == "revenue", F.col("prior")).alias("prior"), "k")
    ratio = lambda name, metric: co.select("company", F.lit(name).alias("metric"), F.round(F.col(metric) / F.col("revenue"), 6).alias("value"), F.array(F.lit(metric), F.lit("revenue")).alias("inputs"))
    ratios = ratio("ebitda_margin", "ebitda").unionByName(ratio("operating_margin", "operating_income"))
    pe = (10 + k % 40 + 0.25).cast("double")
    snapshots = co.where(k % 4 > 0).select("company", pe.alias("trailing_pe"))
    dims = F.array(*(F.struct(F.lit(d).alias("dimension"), ((k * n % 100) / 10.0).alias("score")) for d, n in (("financial_risk", 3), ("market_risk", 7), ("operational_risk", 9))))
    scores = co.where(k % 5 > 0).select("company", F.inline(dims))
    row = lambda rows, kind, metric, value, text: rows.select("company", F.concat(F.lit(f"ev_{kind}_"), "company", F.lit("_"), F.coalesce(metric, F.lit(""))).alias("evidence_id"), F.lit(kind).alias("kind"), metric.cast("string").alias("metric"), value.cast("double").alias("value"), text.cast("string").alias("text"))
    none = F.lit(None)
    evidence = (
        row(fundamentals, "field", F.col("metric"), F.col("value") * F.when(k % 5 == 4, 1.01).otherwise(1.0), none)
        .unionByName(row(co.where(k % 3 > 0), "market", none, none, F.when(k % 3 == 1, F.concat(F.lit("trailing P/E "), F.format_string("%.2f", pe))).otherwise("no price")))
        .unionByName(row(co.where(k % 3 == 0), "supply", none, none, F.lit("one foundry")))
        .unionByName(row(co.where(k % 2 == 0), "risk", none, none, F.lit("screen")))
        .unionByName(row(co.where(k % 6 == 1), "page", none, none, F.lit("Supplier concentration")))
        .unionByName(row(co.where(k % 6 == 5), "page", none, none, F.lit("weather")))
    )
    return companies, fundamentals.drop("k"), ratios, snapshots, scores, evidence


@query(f"WITH {RUN} SELECT claim_id, entity, claim_type, metric_name, round(value::DECIMAL(18, 6), 4)::DOUBLE AS value, label, CASE WHEN good THEN 'verified' ELSE 'rejected' END AS verification, CASE WHEN good THEN 'bound' ELSE no END AS reason FROM claims")
def clm02_all_claims(spark, sf_dir):
    c = B.build_claims(*_run(spark, sf_dir))
    return c.select("claim_id", "entity", "claim_type", "metric_name", F.round("value", 4).alias("value"), "label", "verification", F.when(F.col("verification") == "verified", "bound").otherwise(F.col("reason")).alias("reason"))


THESIS = RUN + """, prof AS (SELECT entity, arg_min(metric_name, place) AS metric_name, arg_min(value, place) AS value FROM (SELECT *, CASE metric_name WHEN 'ebitda_margin' THEN 1 ELSE 2 END AS place FROM claims WHERE good AND metric_name IN ('ebitda_margin', 'operating_margin')) GROUP BY 1),
rsk AS (SELECT entity, arg_min(metric_name, place) AS risk_metric FROM (SELECT *, CASE metric_name WHEN 'financial_risk' THEN 1 WHEN 'market_risk' THEN 2 WHEN 'operational_risk' THEN 3 WHEN 'data_limitation_risk' THEN 4 ELSE 5 END AS place FROM claims WHERE good AND claim_type = 'risk_conclusion') GROUP BY 1),
th AS (SELECT company AS entity, blocked, metric_name, value, risk_metric, NOT blocked AND metric_name IS NOT NULL AND risk_metric IS NOT NULL AS good FROM bound LEFT JOIN prof ON prof.entity = company LEFT JOIN rsk ON rsk.entity = company)"""


@query(f"""WITH {THESIS} SELECT entity, CASE WHEN good THEN CASE WHEN value >= CASE metric_name WHEN 'ebitda_margin' THEN 0.25 ELSE 0.2 END THEN 'quality' WHEN value >= CASE metric_name WHEN 'ebitda_margin' THEN 0.15 ELSE 0.12 END THEN 'neutral' ELSE 'defensive' END END AS stance,
  CASE WHEN good THEN metric_name END AS metric_name, CASE WHEN good THEN risk_metric END AS risk_metric, CASE WHEN blocked OR metric_name IS NULL THEN 'no_verified_profitability' WHEN risk_metric IS NULL THEN 'no_material_risk' ELSE 'composed_of_verified_claims' END AS reason FROM th""")
def clm03_verified_thesis(spark, sf_dir):
    run = _run(spark, sf_dir)
    return B.thesis(run[0], B.build_claims(*run)).select("entity", "stance", "metric_name", "risk_metric", "reason")


@query(f"""WITH {RUN}, m AS (SELECT *, CASE metric WHEN 'ebitda_margin' THEN 'ebitda / revenue' ELSE 'operating_income / revenue' END AS formula FROM ratios UNION ALL SELECT k, company, 'market_cap', s_acctbal, '' FROM bound)
SELECT m.company AS entity, metric AS name, formula, round(m.value::DECIMAL(18, 6), 4)::DOUBLE AS value, CASE metric WHEN 'market_cap' THEN '' WHEN 'ebitda_margin' THEN 'ebitda=' || round(b.ebitda::DECIMAL(18, 4), 2)::DECIMAL(18, 2) || ',revenue=' || round(b.revenue::DECIMAL(18, 4), 2)::DECIMAL(18, 2) ELSE 'operating_income=' || round(b.operating_income::DECIMAL(18, 4), 2)::DECIMAL(18, 2) || ',revenue=' || round(b.revenue::DECIMAL(18, 4), 2)::DECIMAL(18, 2) END AS inputs, CASE WHEN m.k % 2 = 0 AND metric = 'ebitda_margin' THEN 'high' END AS confidence FROM m JOIN bound b USING (k)""")
def clm09_metric_records(spark, sf_dir):
    companies, fundamentals, ratios, *_ = _run(spark, sf_dir)
    s = table(spark, sf_dir, "supplier")
    free = companies.where(~B.blocked(companies)).select("company")
    metrics = ratios.where("value is not null").join(free, "company").select("company", "metric", F.lit("FY1995").alias("period"), "value").unionByName(s.select(F.col("s_name").alias("company"), F.lit("market_cap").alias("metric"), F.lit("FY1995").alias("period"), F.col("s_acctbal").alias("value")))
    given = fundamentals.select("company", "metric", "value", F.lit("FY1995").alias("period"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("citation"), F.lit(None).cast("string").alias("record_id"))
    confidence = s.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("company"), F.lit("ebitda_margin").alias("metric"), F.lit("high").alias("level"))
    formulas = [("ebitda_margin", "ebitda / revenue", ["ebitda", "revenue"]), ("operating_margin", "operating_income / revenue", ["operating_income", "revenue"])]
    rows = B.metric_records(metrics, formulas, given, confidence)
    inputs = F.array_join(F.transform(F.map_entries("inputs"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"]["value"], 2).cast("decimal(18,2)").cast("string"))), ",")
    return rows.select("entity", "name", "formula", F.round("value", 4).alias("value"), F.coalesce(inputs, F.lit("")).alias("inputs"), "confidence")


@query(f"""WITH {RUN} SELECT entity, claim_type, replace(entity || ' ' || replace(metric_name, '_', ' '), '|', '/') AS subject, count(*) AS n FROM claims WHERE good GROUP BY ALL""")
def clm10_claim_ledger(spark, sf_dir):
    """Claims written to their nested form, read back, and listed."""
    back = B.unnested(B.nested(B.build_claims(*_run(spark, sf_dir))))
    return B.ledger(back).groupBy("entity", "claim_type", F.split_part("statement", F.lit(" is "), F.lit(1)).alias("subject")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT conv_id AS answer_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'stale' WHEN 2 THEN 'ok' END AS reason, turn % 2 = 0 AS complete, text FROM conversations)
SELECT answer_id, turn, CASE WHEN coalesce(reason, '') = 'ok' THEN length(text) ELSE length('withheld: ' || coalesce(reason, 'not_validated')) END AS n_chars, CASE WHEN coalesce(reason, '') = 'ok' AND complete THEN 1 ELSE 0 END AS n_citations, CASE WHEN coalesce(reason, '') <> 'ok' THEN 'degraded' WHEN complete THEN 'complete' ELSE 'incomplete' END AS status FROM a""")
def clm10_public_answers(spark, sf_dir):
    m = (F.col("conv_id") + F.col("turn")) % 4
    a = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("answer_id"), F.col("text").alias("answer"), F.array(F.lit("c1")).alias("citations"), (F.col("turn") % 2 == 0).alias("complete"), F.when(m.isin(0, 2), "ok").when(m == 1, "stale").alias("reason"))
    out = B.public_answers(a)
    return out.select(F.col("answer_id.conv_id").alias("answer_id"), F.col("answer_id.turn").alias("turn"), F.length("answer").cast("long").alias("n_chars"), F.size("citations").alias("n_citations"), "status")


@query()
def txt18_financial_facts(spark, sf_dir):
    """Facts of all pages; a sentence with each document's own figures stands before its text."""
    from quarry.operators.chunking import paginate
    from quarry.operators.fact_text import financial_facts

    d = table(spark, sf_dir, "documents")
    lead = F.concat(F.lit("Total net sales were $"), F.format_number("n_chars", 0), F.lit(" million in FY 2024 by segment. Long-term debt of Acme: 1,"), F.lpad((F.col("doc_id") % 900 + 100).cast("string"), 3, "0"), F.lit(" bn. "))
    pages = paginate(d.select("doc_id", F.concat(lead, F.coalesce("text", F.lit(""))).alias("text")))
    return financial_facts(pages.withColumn("issuers", F.array(F.lit("Acme"), F.lit("Other"))))


TAGS = """tags AS (SELECT l_suppkey AS cik, CASE WHEN l_returnflag = 'R' THEN 'OperatingIncomeLoss' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'DepreciationAndAmortization' WHEN l_returnflag = 'A' THEN 'DepreciationDepletionAndAmortization' ELSE 'Assets' END AS tag,
  l_orderkey * 10 + l_linenumber AS accn, CAST(last_day(l_shipdate) AS DATE) AS "end", l_extendedprice * 100000 AS val, l_partkey FROM lineitem WHERE l_quantity > 5)"""


@query(f"""WITH {TAGS}, one AS (SELECT cik, tag, "end", max(accn * 1000000 + l_partkey) AS top FROM tags GROUP BY 1, 2, 3), f AS (SELECT one.cik, one.tag, one."end", max(val) AS val, max(accn) AS accn FROM one JOIN tags t ON t.cik = one.cik AND t.tag = one.tag AND t."end" = one."end" AND t.accn * 1000000 + t.l_partkey = one.top GROUP BY 1, 2, 3),
d AS (SELECT cik, "end", arg_min(tag, CASE tag WHEN 'DepreciationDepletionAndAmortization' THEN 1 ELSE 2 END) AS tag FROM f WHERE tag LIKE 'Depreciation%' GROUP BY 1, 2)
SELECT o.cik, o."end", round((o.val + x.val) / 1e9 + 1e-12, 4) AS ebitda, 'sec:' || o.cik || ':OperatingIncomeLoss:' || o.accn || ':' || o."end" || '+sec:' || o.cik || ':' || d.tag || ':' || x.accn || ':' || o."end" AS record_id, 'approx OperatingIncomeLoss + ' || d.tag AS note FROM f o JOIN d ON d.cik = o.cik AND d."end" = o."end" JOIN f x ON x.cik = d.cik AND x."end" = d."end" AND x.tag = d.tag WHERE o.tag = 'OperatingIncomeLoss'""")
def qnt09_ebitda_with_depreciation(spark, sf_dir):
    """Line items stand for filed facts, a month for a period. Facts of one accession differ by part."""
    from quarry.operators.fact_text import ebitda_approximation

    flag = F.col("l_returnflag")
    tag = F.when(flag == "R", "OperatingIncomeLoss").when((flag == "A") & (F.col("l_linestatus") == "F"), "DepreciationAndAmortization").when(flag == "A", "DepreciationDepletionAndAmortization").otherwise("Assets")
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 5").select(F.col("l_suppkey").alias("cik"), tag.alias("tag"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("accn"), F.last_day("l_shipdate").alias("end"), (F.col("l_extendedprice") * 100000).alias("val"), "l_partkey")
    one = rows.groupBy("cik", "tag", "end", "accn").agg(F.max_by("val", "l_partkey").alias("val"))
    return ebitda_approximation(one.withColumn("accn", F.lpad(F.col("accn").cast("string"), 12, "0"))).withColumn("record_id", F.regexp_replace("record_id", ":0+(?=[0-9]+:)", ":"))


@query("""SELECT s_suppkey AS page_id, 'Acme' AS company, 'revenue' AS metric, round(s_acctbal, 2)::DOUBLE AS value FROM supplier WHERE s_suppkey % 3 > 0 UNION ALL SELECT s_suppkey, s_name, 'ebitda', CAST(1000 + s_suppkey AS DOUBLE) FROM supplier
UNION ALL SELECT s_suppkey, s_name, 'revenue', 7.5 FROM supplier""")
def txt38_peer_lines(spark, sf_dir):
    """Peer pages whose lines are a company's name or a label with a number."""
    from quarry.operators.fact_text import peer_table_rows

    k = F.col("s_suppkey")
    text = F.concat_ws("\n", F.lit("Revenue | 5"), F.when(k % 3 > 0, F.concat(F.lit("| aCME |\nRevenue : $"), F.format_string("%.2f", "s_acctbal"))), F.upper("s_name"), F.concat(F.lit("EBITDA | "), F.format_number(1000 + k, 0), F.lit(" |")), F.lit("margin of 12 points\nNet sales 7.5\nOther 9"))
    lines = table(spark, sf_dir, "supplier").select(k.alias("page_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    names = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("alias"), F.col("s_name").alias("company"))
    aliases = spark.createDataFrame([("Acme Inc", "Acme")], "alias string, company string").unionByName(names)
    labels = spark.createDataFrame([("revenue", "revenue"), ("net sales", "revenue"), ("ebitda", "ebitda")], "label string, metric string")
    return peer_table_rows(lines, aliases, labels)


@query("""SELECT doc_id, regexp_replace(trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')), '^(the|a) ', '') AS squeezed, 'doc-' || substr(sha256(coalesce(text, '')), 1, 16) AS fingerprint, round(least(1.0, greatest(0.0, n_chars / 1000.0)), 3) AS clamped, round(log2(n_chars + 1), 4) AS log_size, abs(n_chars - 500) <= 0.2 * 500 AS near_500,
  lang || '/' || source AS tags FROM documents""")
def fun01_fun02_fun05_fun06_scalars(spark, sf_dir):
    """Strings, hashes, clamped and tolerant numbers, and ordered distinct lists, a row a document."""
    text = F.coalesce("text", F.lit(""))
    n = F.col("n_chars")
    labels = F.array("lang", "source", "lang")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.regexp_replace(T.squeezed(F.col("text")), "^(the|a) ", "").alias("squeezed"),
        F.concat(F.lit("doc-"), F.substring(F.sha2(text, 256), 1, 16)).alias("fingerprint"),
        F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), n / 1000.0)), 3).alias("clamped"),
        F.round(F.log2(n + 1), 4).alias("log_size"),
        (F.abs(n - 500) <= 0.2 * 500).alias("near_500"),
        F.array_join(F.slice(F.array_distinct(labels), 1, 2), "/").alias("tags"),
    )


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Acme' WHEN 1 THEN 'Globex' WHEN 2 THEN 'Acme' WHEN 3 THEN 'Globex' END AS primary_, CASE doc_id % 5 WHEN 0 THEN 'filename' WHEN 1 THEN 'form_10k_header' WHEN 2 THEN 'peer_table_header' WHEN 3 THEN 'cover_frequency' ELSE 'none' END AS method,
  CASE doc_id % 5 WHEN 2 THEN 'Acme,Globex' WHEN 4 THEN '' WHEN 0 THEN 'Acme' ELSE 'Globex' END AS issuers FROM documents WHERE NOT regexp_matches(lower(coalesce(text, '')), 'acmex|globex')""")
def txt23_document_issuers(spark, sf_dir):
    """Documents whose file name, form header, table header or cover names a company, or none."""
    from quarry.operators.fact_text import document_issuers

    k = F.col("doc_id") % 5
    name = F.when(k == 0, "up/acmex_fy2024.pdf").otherwise("x.pdf")
    cover = F.when(k == 1, "FORM 10-K annual report of Globex Corporation\n").when(k == 2, "Metric | Acme | Globex\nacmex acmex acmex\n").when(k == 3, "globex and globex\n").otherwise("")
    d = docs(spark, sf_dir).where(~F.lower(F.coalesce("text", F.lit(""))).rlike("acmex|globex"))
    found = document_issuers(d.select("doc_id", name.alias("filename"), F.array(F.concat(cover, F.coalesce("text", F.lit("")))).alias("pages")), [("acmex", "Acme"), ("acme |", "Acme"), ("globex", "Globex")])
    return found.select("doc_id", F.col("primary").alias("primary_"), "method", F.array_join("issuers", ",").alias("issuers"))
