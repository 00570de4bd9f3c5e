"""Tables of the shapes that the operators take, derived from the given tables.

The test data has no filings and no search logs, so suppliers stand for queries and companies, parts
for chunks and metrics, ship years for fiscal years, and events for calls. Each table has its SQL
for the DuckDB statements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import table

HITS = """hits AS (
  SELECT * FROM (
    SELECT query_id, mode, chunk_id, score, 'D' || CAST(chunk_id % 400 AS VARCHAR) AS doc, chunk_id % 5 + 1 AS page,
           row_number() OVER (PARTITION BY query_id, mode ORDER BY score DESC, chunk_id) AS rank
    FROM (SELECT l_suppkey AS query_id, CASE l_linestatus WHEN 'O' THEN 'bm25' ELSE 'dense' END AS mode,
                 l_partkey AS chunk_id, max(l_extendedprice) AS score
          FROM lineitem GROUP BY 1, 2, 3)) WHERE rank <= 50)"""


def hits(spark: SparkSession, sf_dir: str, depth: int = 50) -> DataFrame:
    """(query_id, mode, chunk_id, score, doc, page, rank): two channels' ranked lists per query."""
    best = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("query_id"), F.when(F.col("l_linestatus") == "O", "bm25").otherwise("dense").alias("mode"), F.col("l_partkey").alias("chunk_id"))
        .agg(F.max("l_extendedprice").alias("score"))
    )
    order = Window.partitionBy("query_id", "mode").orderBy(F.desc("score"), "chunk_id")
    return (
        best.withColumn("rank", F.row_number().over(order).cast("long"))
        .where(F.col("rank") <= depth)
        .withColumns({"doc": F.concat(F.lit("D"), (F.col("chunk_id") % 400).cast("string")), "page": F.col("chunk_id") % 5 + 1})
    )


QRELS = """qrels AS (
  SELECT l_suppkey AS query_id, l_partkey AS chunk_id, CAST(CASE WHEN max(l_quantity) >= 48 THEN 2 ELSE 1 END AS BIGINT) AS relevance
  FROM lineitem GROUP BY 1, 2 HAVING max(l_quantity) >= 45)"""


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, chunk_id, relevance 1 or 2)"""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("chunk_id"))
        .agg(F.max("l_quantity").alias("q"))
        .where("q >= 45")
        .select("query_id", "chunk_id", F.when(F.col("q") >= 48, 2).otherwise(1).cast("long").alias("relevance"))
    )


FACTS = """facts AS (
  SELECT s_name AS company, metric, CAST(fy AS BIGINT) AS fy, CAST(sum(value) AS BIGINT) / 10000.0::DOUBLE AS value
  FROM (SELECT l_suppkey, CASE l_returnflag WHEN 'A' THEN 'revenue' WHEN 'N' THEN 'ebitda' ELSE 'operating_income' END AS metric,
               year(l_shipdate) AS fy, CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(100 - l_discount * 100) AS BIGINT) * CASE l_returnflag WHEN 'A' THEN 4 ELSE 1 END AS value
        FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey
  GROUP BY 1, 2, 3)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(company, metric, fy, value): fundamentals in long form, summed in whole hundredths of cents."""
    flag = F.col("l_returnflag")
    lines = table(spark, sf_dir, "lineitem")
    sums = lines.groupBy(
        "l_suppkey", F.when(flag == "A", "revenue").when(flag == "N", "ebitda").otherwise("operating_income").alias("metric"), F.year("l_shipdate").cast("long").alias("fy")
    ).agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long") * F.round(100 - F.col("l_discount") * 100).cast("long") * F.when(flag == "A", 4).otherwise(1)) / 10000.0).alias("value"))
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("company"))
    return sums.join(names, "l_suppkey").select("company", "metric", "fy", "value")


CALLS = """calls AS (
  SELECT event_id, ts, user_id AS run_id, event_id // 3 AS logical_call_id, event_id % 3 + 1 AS attempt, event_type AS provider, value AS latency_ms,
         CASE WHEN event_type = 'error' THEN CASE CAST(json_extract(props, '$.k') AS BIGINT) % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'not_found' ELSE 'error' END END AS error_class,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k
  FROM events)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider calls: three attempts a logical call, errors with a class."""
    k = F.get_json_object("props", "$.k").cast("long")
    wrong = F.when(k % 4 == 0, "timeout").when(k % 4 == 1, "rate_limited").when(k % 4 == 2, "not_found").otherwise("error")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.col("user_id").alias("run_id"),
        F.floor(F.col("event_id") / 3).alias("logical_call_id"),
        (F.col("event_id") % 3 + 1).alias("attempt"),
        F.col("event_type").alias("provider"),
        F.col("value").alias("latency_ms"),
        F.when(F.col("event_type") == "error", wrong).alias("error_class"),
        k.alias("k"),
    )
