"""Queries of company payloads: orders stand for documents, customers for companies, line items for amounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.payload import company_payloads
from quarry.plans.registry import query
from quarry.session import table

METRICS = ("revenue", "ebitda_2025", "r_and_d", "operating_income", "gross_margin", "revenue_2025", "ebitda")
SOURCES = (None, "provider_metadata", "table_caption", "inline_unit", "guess")

PAYLOAD = f"""d AS (SELECT o_orderkey AS doc_id, o_custkey AS c, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS n FROM orders),
own AS (SELECT 'C' || c AS company, n, doc_id FROM d UNION ALL SELECT 'C' || (c + 1), n, doc_id FROM d WHERE n = 2),
a AS (SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber % 2 = 1 AND l_orderkey % 3 > 0 THEN 'C' || c END AS whose, l_linenumber * 10000000 + l_partkey AS no, {list(METRICS)}[(l_linenumber - 1) % 7 + 1] AS metric,
  l_extendedprice / 100 AS v, CASE WHEN l_returnflag = 'R' THEN 'EUR' ELSE 'USD' END AS currency, CASE WHEN l_quantity > 10 THEN 'high' ELSE 'low' END AS confidence,
  CASE l_suppkey % 3 WHEN 0 THEN 'Annual' WHEN 1 THEN 'FY2001' END AS period, CASE WHEN l_linestatus = 'O' THEN 'annual' WHEN l_partkey % 7 = 0 THEN 'quarter' END AS period_type,
  CASE l_partkey % 5 WHEN 1 THEN 'provider_metadata' WHEN 2 THEN 'table_caption' WHEN 3 THEN 'inline_unit' WHEN 4 THEN 'guess' END AS source, CASE WHEN l_partkey % 11 = 0 THEN 'r' || l_partkey END AS record_id FROM lineitem JOIN d ON l_orderkey = doc_id),
s AS (SELECT own.company, a.* FROM own JOIN a ON a.doc_id = own.doc_id AND a.whose = own.company
  UNION ALL SELECT own.company, a.* FROM own JOIN a ON a.doc_id = own.doc_id AND a.whose IS NULL AND own.n = 1 AND NOT EXISTS (SELECT 1 FROM a x WHERE x.doc_id = own.doc_id AND x.whose = own.company)),
j AS (SELECT *, replace(metric, '_2025', '') AS base, CASE WHEN metric = 'gross_margin' THEN 'not_fundamental' WHEN source IS NULL THEN 'legacy_unverified'
  WHEN NOT (confidence = 'high' AND currency = 'USD' AND period_type IS DISTINCT FROM 'quarter' AND source IN ('table_caption', 'inline_unit', 'provider_metadata') AND (source <> 'provider_metadata' OR coalesce(period = 'FY2001', false))) THEN 'untrusted'
  WHEN metric LIKE 'revenue%' AND v > 800 THEN 'implausible' END AS refused FROM s)"""


def _payloads(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("c"))
    k, name = F.col("doc_id"), lambda c: F.concat(F.lit("C"), c.cast("string"))
    say = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    docs = o.select(
        "doc_id", k.alias("doc_pos"), F.when(k % 4 == 0, F.array(name(F.col("c")), name(F.col("c") + 1))).otherwise(F.array(name(F.col("c")))).alias("companies"),
        F.when(k % 5 == 0, say("On order ", k, ": SUPPLY CHAIN RISK.")).when(k % 5 == 1, say("Order ", k)).alias("text"),
        F.when(k % 3 == 0, F.repeat(say("Order ", k, " went well. "), 60)).when(k % 3 == 1, "").alias("excerpt"), say("doc", k, "#p1").alias("citation"),
    )
    li, p = table(spark, sf_dir, "lineitem"), F.col("l_partkey")
    of = lambda values, n: F.array(*map(F.lit, values))[(n % len(values)).cast("int")]
    amounts = li.join(o.withColumnRenamed("doc_id", "l_orderkey"), "l_orderkey").select(
        F.col("l_orderkey").alias("doc_id"), F.when((F.col("l_linenumber") % 2 == 1) & (F.col("l_orderkey") % 3 > 0), name(F.col("c"))).alias("company"),
        (F.col("l_linenumber") * 10000000 + p).alias("amount_no"), of(METRICS, F.col("l_linenumber") - 1).alias("metric"), (F.col("l_extendedprice") / 100).alias("normalized_value"), F.lit("billion_usd").alias("unit"),
        F.when(F.col("l_returnflag") == "R", "EUR").otherwise("USD").alias("currency"), F.when(F.col("l_quantity") > 10, "high").otherwise("low").alias("confidence"), of(("Annual", "FY2001", None), F.col("l_suppkey")).alias("period"),
        F.when(F.col("l_linestatus") == "O", "annual").when(p % 7 == 0, "quarter").alias("period_type"), F.lit(None).cast("string").alias("period_end"), of(SOURCES, p).alias("source"),
        F.when(p % 5 == 1, "p").alias("provider"), F.lit(True).alias("is_normalized"), F.lit(None).cast("string").alias("citation"), F.when(p % 11 == 0, say("r", p)).alias("record_id"),
    )
    return company_payloads(docs, amounts)


@query(f"""WITH {PAYLOAD}, r AS (SELECT *, row_number() OVER (PARTITION BY company, metric ORDER BY doc_id DESC, no DESC, v DESC) AS nth FROM j WHERE refused IS NULL)
SELECT company, metric, v AS value, doc_id, CASE WHEN source = 'provider_metadata' THEN source ELSE 'document_extracted' END AS source, CASE WHEN source = 'provider_metadata' THEN 'p' END AS provider, CASE WHEN period = 'FY2001' THEN period END AS period,
  CASE WHEN period = 'Annual' THEN 'annual' ELSE period_type END AS period_type, 'doc' || doc_id || '#p1' AS citation, coalesce(record_id, 'document:' || doc_id || ':' || base) AS source_record_id FROM r WHERE nth = 1""")
def jon25_fundamentals(spark, sf_dir):
    p = F.col("provenance")
    return _payloads(spark, sf_dir)["fundamentals"].select("company", "metric", "value", "doc_id", *(p[c].alias(c) for c in ("source", "provider", "period", "period_type", "citation", "source_record_id")))


@query(f"""WITH {PAYLOAD}, r AS (SELECT *, row_number() OVER (PARTITION BY company, metric ORDER BY doc_id DESC, no DESC, v DESC) AS nth FROM j)
SELECT company, metric, v AS value, confidence, coalesce(source, 'legacy_unverified') AS source, doc_id, refused FROM r WHERE nth = 1""")
def jon25_observations(spark, sf_dir):
    return _payloads(spark, sf_dir)["observations"]


@query("""WITH d AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders), own AS (SELECT c, k FROM d UNION ALL SELECT c + 1, k FROM d WHERE k % 4 = 0)
SELECT 'C' || c AS company, k AS doc_pos, k AS doc_id, substr(repeat('Order ' || k || ' went well. ', 60), 1, 500) AS quote FROM own WHERE k % 3 = 0""")
def jon25_quotes(spark, sf_dir):
    return _payloads(spark, sf_dir)["quotes"]


@query(f"""WITH {PAYLOAD} SELECT company, count(*) AS n_documents, count(CASE WHEN doc_id % 5 = 0 THEN 1 END) AS n_signals, CASE WHEN count(CASE WHEN doc_id % 5 = 0 THEN 1 END) > 0 THEN 'medium' ELSE 'unknown' END AS risk_level,
  count(CASE WHEN doc_id % 3 = 0 THEN 1 END) AS n_quotes, CASE WHEN company IN (SELECT company FROM j WHERE refused IS NULL) THEN 'document_extracted' ELSE 'none' END AS structured_source FROM own GROUP BY company""")
def jon25_companies(spark, sf_dir):
    return _payloads(spark, sf_dir)["companies"]
