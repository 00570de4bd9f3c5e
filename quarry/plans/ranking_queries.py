"""Queries of ranking metrics, comparisons and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import ranking as R
from quarry.plans.registry import query
from quarry.plans.standins import HITS, QRELS, hits, qrels

JUDGED = """judged AS (
  SELECT h.*, coalesce(q.relevance, 0) AS relevance FROM hits h LEFT JOIN qrels q USING (query_id, chunk_id)),
ideal AS (
  SELECT query_id, count(*) AS n_gold,
         sum(CASE WHEN place <= 10 THEN 1.0 / log2(place + 1) END) AS ideal,
         sum(CASE WHEN place <= 10 THEN (pow(2, relevance) - 1) / log2(place + 1) END) AS graded_ideal
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, chunk_id) AS place FROM qrels) GROUP BY 1),
cases AS (
  SELECT query_id, mode,
         CAST(max(CASE WHEN relevance > 0 AND rank <= 1 THEN 1 ELSE 0 END) AS BIGINT) AS hit_1,
         CAST(max(CASE WHEN relevance > 0 AND rank <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS hit_3,
         CAST(max(CASE WHEN relevance > 0 AND rank <= 5 THEN 1 ELSE 0 END) AS BIGINT) AS hit_5,
         CAST(max(CASE WHEN relevance > 0 AND rank <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS hit_10,
         round(coalesce(count(CASE WHEN relevance > 0 AND rank <= 1 THEN 1 END) / max(n_gold), 0.0), 4) AS recall_1,
         round(coalesce(count(CASE WHEN relevance > 0 AND rank <= 3 THEN 1 END) / max(n_gold), 0.0), 4) AS recall_3,
         round(coalesce(count(CASE WHEN relevance > 0 AND rank <= 5 THEN 1 END) / max(n_gold), 0.0), 4) AS recall_5,
         round(coalesce(count(CASE WHEN relevance > 0 AND rank <= 10 THEN 1 END) / max(n_gold), 0.0), 4) AS recall_10,
         round(coalesce(1.0 / min(CASE WHEN relevance > 0 THEN rank END), 0.0), 4) AS rr,
         CAST(coalesce(min(CASE WHEN relevance > 0 THEN rank END), 0) AS BIGINT) AS first_rank,
         round(coalesce(sum(CASE WHEN relevance > 0 AND rank <= 10 THEN 1.0 / log2(rank + 1) ELSE 0 END) / max(ideal), 0.0), 4) AS ndcg,
         round(coalesce(sum(CASE WHEN relevance > 0 AND rank <= 10 THEN (pow(2, relevance) - 1) / log2(rank + 1) ELSE 0 END) / max(graded_ideal), 0.0), 4) AS graded_ndcg,
         CAST(max(CASE WHEN relevance > 0 THEN 1 ELSE 0 END) AS BIGINT) AS pool_hit,
         coalesce(max(n_gold), 0) AS n_gold
  FROM judged LEFT JOIN ideal USING (query_id) GROUP BY 1, 2)"""
CASES = f"WITH {HITS}, {QRELS}, {JUDGED}"


def _cases(spark, sf_dir):
    return R.score_cases(hits(spark, sf_dir), qrels(spark, sf_dir))


@query(CASES + " SELECT query_id, mode, hit_1, hit_3, hit_5, hit_10 FROM cases")
def win01_hit_at_k(spark, sf_dir):
    return _cases(spark, sf_dir).select("query_id", "mode", "hit_1", "hit_3", "hit_5", "hit_10")


@query(CASES + " SELECT query_id, mode, recall_1, recall_3, recall_5, recall_10 FROM cases")
def win02_recall_at_k(spark, sf_dir):
    return _cases(spark, sf_dir).select("query_id", "mode", "recall_1", "recall_3", "recall_5", "recall_10")


@query(CASES + " SELECT query_id, mode, ndcg FROM cases")
def win03_ndcg(spark, sf_dir):
    return _cases(spark, sf_dir).select("query_id", "mode", "ndcg")


@query(CASES + " SELECT query_id, mode, graded_ndcg FROM cases")
def win04_graded_ndcg(spark, sf_dir):
    return _cases(spark, sf_dir).select("query_id", "mode", "graded_ndcg")


@query(CASES + " SELECT query_id, mode, rr, first_rank FROM cases")
def win05_reciprocal_rank(spark, sf_dir):
    return _cases(spark, sf_dir).select("query_id", "mode", "rr", "first_rank")


@query(f"""
WITH {HITS}, kept AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, mode, doc, page ORDER BY rank) AS nth FROM hits)
SELECT * FROM (SELECT query_id, mode, chunk_id, doc, page, rank, row_number() OVER (PARTITION BY query_id, mode ORDER BY rank) AS page_rank FROM kept WHERE nth = 1)
WHERE page_rank <= 10""")
def win06_collapse_pages(spark, sf_dir):
    return R.collapse_pages(hits(spark, sf_dir)).select("query_id", "mode", "chunk_id", "doc", "page", "rank", "page_rank")


@query(f"""
WITH {HITS} SELECT query_id, mode, count(*) AS n_hits, count(page) AS n_identified, count(DISTINCT (doc, page)) AS n_pages,
  round(count(page) / count(*), 4) AS coverage, count(page) - count(DISTINCT (doc, page)) AS duplicates
FROM hits WHERE rank <= 10 GROUP BY 1, 2""")
def win07_page_occupancy(spark, sf_dir):
    return R.page_occupancy(hits(spark, sf_dir))


MOVES = CASES + """, moved AS (
  SELECT query_id, a.first_rank AS before, b.first_rank AS after FROM (SELECT * FROM cases WHERE mode = 'bm25') a JOIN (SELECT * FROM cases WHERE mode = 'dense') b USING (query_id)),
moves AS (
  SELECT *, CASE WHEN before = 0 AND after = 0 THEN 'never' WHEN before = 0 THEN 'improved' WHEN after = 0 THEN 'degraded'
                 WHEN after < before THEN 'improved' WHEN after > before THEN 'degraded' ELSE 'tied' END AS movement FROM moved)"""


def _moves(spark, sf_dir):
    cases = _cases(spark, sf_dir)
    return R.rank_movement(cases.where("mode = 'bm25'"), cases.where("mode = 'dense'"))


@query(MOVES + " SELECT * FROM moves")
def win10_rank_movement(spark, sf_dir):
    return _moves(spark, sf_dir)


@query(f"""
WITH {HITS}, arms(arm, w, by_page) AS (VALUES ('A_prod', 20, false), ('B_wide', 50, false), ('R_page', 50, true)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, mode, arm, doc, page ORDER BY rank) AS nth FROM hits, arms WHERE rank <= w)
SELECT query_id, mode, arm, chunk_id, rank, pool_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, mode, arm ORDER BY rank) AS pool_rank FROM r WHERE NOT by_page OR nth = 1) WHERE pool_rank <= 20""")
def win11_arm_pools(spark, sf_dir):
    return R.arm_pools(hits(spark, sf_dir)).select("query_id", "mode", "arm", "chunk_id", "rank", "pool_rank")


@query("""
SELECT * FROM (
  SELECT l_suppkey AS query_id, l_orderkey * 10 + l_linenumber AS chunk_id, l_extendedprice AS score,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber, l_partkey) AS top_rank FROM lineitem)
WHERE top_rank <= 10""")
def win12_top_k(spark, sf_dir):
    from quarry.session import table

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.col("l_extendedprice").alias("score"), "l_partkey")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id", "l_partkey")
    return rows.withColumn("top_rank", F.row_number().over(order).cast("long")).where("top_rank <= 10").drop("l_partkey")


MEANS = "count(*) AS n_cases, " + ", ".join(f"round(avg({c}) + 1e-9, 4) AS {c}" for c in ("hit_1", "hit_3", "hit_5", "hit_10", "recall_10", "rr", "ndcg", "graded_ndcg"))


@query(CASES + f" SELECT mode, {MEANS} FROM cases GROUP BY mode")
def agg01_case_metrics(spark, sf_dir):
    return R.summarize(_cases(spark, sf_dir), "mode")


@query(CASES + """, labelled AS (SELECT *, 'n' || CAST(n_nationkey AS VARCHAR) AS nation, CASE WHEN s_acctbal < 0 THEN 'debt' ELSE 'credit' END AS balance
  FROM cases JOIN supplier ON s_suppkey = query_id JOIN nation ON n_nationkey = s_nationkey)
SELECT CASE WHEN grouping(mode) = 0 THEN 'mode' WHEN grouping(nation) = 0 THEN 'nation' ELSE 'balance' END AS label, coalesce(mode, nation, balance) AS value,
  count(*) AS n_cases, round(avg(hit_10) + 1e-9, 4) AS hit_10, round(avg(rr) + 1e-9, 4) AS rr
FROM labelled GROUP BY GROUPING SETS ((mode), (nation), (balance))""")
def agg02_breakdowns(spark, sf_dir):
    from quarry.session import table

    who = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("nation"), F.when(F.col("s_acctbal") < 0, "debt").otherwise("credit").alias("balance"))
    _cases(spark, sf_dir).join(who, "query_id").createOrReplaceTempView("quarry_labelled_cases")
    return spark.sql("""
      SELECT CASE WHEN grouping(mode) = 0 THEN 'mode' WHEN grouping(nation) = 0 THEN 'nation' ELSE 'balance' END AS label, coalesce(mode, nation, balance) AS value,
             count(*) AS n_cases, round(avg(hit_10) + 1e-9, 4) AS hit_10, round(avg(rr) + 1e-9, 4) AS rr
      FROM quarry_labelled_cases GROUP BY GROUPING SETS ((mode), (nation), (balance))""")


CLASSES = CASES + """, classes AS (SELECT query_id, mode, first_rank, CASE WHEN n_gold = 0 THEN 'invalid_gold' WHEN first_rank BETWEEN 1 AND 10 THEN 'hit_at_10' WHEN first_rank BETWEEN 11 AND 20 THEN 'gold_rank_11_20'
  WHEN first_rank BETWEEN 21 AND 30 THEN 'gold_rank_21_30' WHEN first_rank BETWEEN 31 AND 50 THEN 'gold_rank_31_50' ELSE 'gold_not_in_top50' END AS failure FROM cases)"""


@query(CLASSES + " SELECT mode, failure, count(*) AS n FROM classes GROUP BY 1, 2")
def agg03_failure_counts(spark, sf_dir):
    return R.failure_class(_cases(spark, sf_dir)).groupBy("mode", "failure").agg(F.count("*").alias("n"))


@query(CLASSES + " SELECT * FROM classes")
def txt31_failure_class(spark, sf_dir):
    return R.failure_class(_cases(spark, sf_dir))


@query(CASES + """ SELECT mode, count(*) AS n, count(CASE WHEN first_rank BETWEEN 1 AND 10 THEN 1 END) AS hit_10, count(CASE WHEN first_rank BETWEEN 1 AND 20 THEN 1 END) AS hit_20,
  count(CASE WHEN first_rank BETWEEN 1 AND 30 THEN 1 END) AS hit_30, count(CASE WHEN first_rank BETWEEN 1 AND 50 THEN 1 END) AS hit_50, round(avg(nullif(first_rank, 0)), 4) AS mean_rank
FROM cases GROUP BY mode""")
def agg04_depth(spark, sf_dir):
    r = F.col("first_rank")
    return _cases(spark, sf_dir).groupBy("mode").agg(F.count("*").alias("n"), *(F.count_if((r >= 1) & (r <= k)).alias(f"hit_{k}") for k in (10, 20, 30, 50)), F.round(F.avg(F.nullif(r, F.lit(0))), 4).alias("mean_rank"))


@query("""SELECT event_type AS arm, count(*) AS n, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, round(avg(value), 4) AS mean
FROM events GROUP BY 1""")
def agg05_arm_latency(spark, sf_dir):
    from quarry.session import table

    disc = lambda q: F.expr(f"percentile_disc({q}) within group (order by value)")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("arm")).agg(F.count("*").alias("n"), disc(0.5).alias("p50"), disc(0.95).alias("p95"), F.round(F.avg("value"), 4).alias("mean"))


@query("""
WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS nth, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(CASE WHEN nth = greatest(1, CAST(ceil(0.9 * n) AS BIGINT)) THEN value END) AS nearest_rank, max(CASE WHEN nth = CAST(round_even(0.9 * (n - 1), 0) AS BIGINT) + 1 THEN value END) AS rounded_index
FROM o GROUP BY 1""")
def agg06_percentiles(spark, sf_dir):
    """Both percentile definitions; only the rows at the wanted places leave their range partitions."""
    from quarry.operators.groups import values_at
    from quarry.session import table

    n = F.col("n")
    rows = table(spark, sf_dir, "events").select("event_type", "value", "event_id")
    return values_at(rows, ["event_type"], ["value", "event_id"], "value", nearest_rank=F.greatest(F.lit(1), F.ceil(0.9 * n)) - 1, rounded_index=F.bround(0.9 * (n - 1), 0))


PAIR = CASES + """, pair AS (SELECT query_id, row_number() OVER (ORDER BY query_id) - 1 AS position, a.hit_10 AS a, b.hit_10 AS b, a.rr AS ra, b.rr AS rb
  FROM (SELECT * FROM cases WHERE mode = 'bm25') a JOIN (SELECT * FROM cases WHERE mode = 'dense') b USING (query_id)),
draws AS (SELECT r.range AS resample, ('0x' || substr(md5('7-' || r.range || '-' || i.range), 1, 12))::BIGINT % (SELECT count(*) FROM pair) AS position
  FROM range(1000) r, range((SELECT count(*) FROM pair)) i)"""


def _pair(spark, sf_dir):
    cases = _cases(spark, sf_dir).select("query_id", "mode", "hit_10", "rr")
    a = cases.where("mode = 'bm25'").select("query_id", F.col("hit_10").alias("a"), F.col("rr").alias("ra"))
    b = cases.where("mode = 'dense'").select("query_id", F.col("hit_10").alias("b"), F.col("rr").alias("rb"))
    return a.join(b, "query_id")


def _numbered(pair):
    return R.numbered(pair, "query_id")


@query(PAIR + """, means AS (SELECT resample, avg(ra) AS m FROM draws JOIN pair USING (position) GROUP BY 1)
SELECT round(percentile_disc(0.025) WITHIN GROUP (ORDER BY m), 4) AS low, round(percentile_disc(0.975) WITHIN GROUP (ORDER BY m), 4) AS high FROM means""")
def agg07_bootstrap_ci(spark, sf_dir):
    means = R.bootstrap_means(_numbered(_pair(spark, sf_dir)), 1000, 7, "ra")
    return R.percentile_bounds(means, "ra")


@query(PAIR + """, means AS (SELECT resample, avg(rb - ra) AS m FROM draws JOIN pair USING (position) GROUP BY 1)
SELECT round(percentile_disc(0.025) WITHIN GROUP (ORDER BY m), 4) AS low, round(percentile_disc(0.975) WITHIN GROUP (ORDER BY m), 4) AS high FROM means""")
def agg08_paired_bootstrap(spark, sf_dir):
    pair = _numbered(_pair(spark, sf_dir)).withColumn("delta", F.col("rb") - F.col("ra"))
    return R.percentile_bounds(R.bootstrap_means(pair, 1000, 7, "delta"), "delta")


TABLE = """counts AS (SELECT count(CASE WHEN a = 1 AND b = 1 THEN 1 END) AS both, count(CASE WHEN a = 1 AND b = 0 THEN 1 END) AS only_a, count(CASE WHEN a = 0 AND b = 1 THEN 1 END) AS only_b,
  count(CASE WHEN a = 0 AND b = 0 THEN 1 END) AS neither FROM pair),
p AS (SELECT *, only_a + only_b AS n, least(only_a, only_b) AS k FROM counts)"""


@query(PAIR + f""", {TABLE}
SELECT "both", only_a, only_b, neither, round(CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) FROM range(k + 1) t(i))) END, 4) AS p_value FROM p""")
def agg09_mcnemar(spark, sf_dir):
    return R.mcnemar(_pair(spark, sf_dir), "a", "b")


@query(MOVES + """ SELECT count(*) AS n, count(CASE WHEN movement = 'improved' THEN 1 END) AS improved, count(CASE WHEN movement = 'degraded' THEN 1 END) AS degraded,
  count(CASE WHEN movement = 'tied' THEN 1 END) AS tied, count(CASE WHEN movement = 'never' THEN 1 END) AS never FROM moves""")
def agg10_movement_counts(spark, sf_dir):
    m = F.col("movement")
    return _moves(spark, sf_dir).agg(F.count("*").alias("n"), *(F.count_if(m == x).alias(x) for x in ("improved", "degraded", "tied", "never")))


@query(MOVES + """ SELECT count(*) AS n_focus, count(CASE WHEN after BETWEEN 1 AND 10 THEN 1 END) AS rescued, count(CASE WHEN after = 0 THEN 1 END) AS lost,
  count(CASE WHEN after > 10 THEN 1 END) AS still_deep FROM moves WHERE before BETWEEN 11 AND 30""")
def agg12_focus_cohort(spark, sf_dir):
    a = F.col("after")
    return _moves(spark, sf_dir).where("before between 11 and 30").agg(F.count("*").alias("n_focus"), F.count_if((a >= 1) & (a <= 10)).alias("rescued"), F.count_if(a == 0).alias("lost"), F.count_if(a > 10).alias("still_deep"))


@query(CASES + """, s AS (SELECT avg(CASE WHEN mode = 'bm25' THEN hit_10 END) AS b, avg(CASE WHEN mode = 'dense' THEN hit_10 END) AS d, avg(pool_hit) AS p FROM cases)
SELECT p - greatest(b, d) > 0.05 AS rerank_helps, b > d AS prefer_bm25, abs(b - d) < 0.02 AS use_fusion FROM s""")
def agg13_recommendations(spark, sf_dir):
    side = lambda m: F.avg(F.when(F.col("mode") == m, F.col("hit_10")))
    one = _cases(spark, sf_dir).agg(side("bm25").alias("b"), side("dense").alias("d"), F.avg("pool_hit").alias("p"))
    return one.select((F.col("p") - F.greatest("b", "d") > 0.05).alias("rerank_helps"), (F.col("b") > F.col("d")).alias("prefer_bm25"), (F.abs(F.col("b") - F.col("d")) < 0.02).alias("use_fusion"))


@query(CASES + """, s AS (SELECT mode, unnest(['hit_10', 'rr', 'ndcg']) AS metric, unnest([avg(hit_10), avg(rr), avg(ndcg)]) AS actual FROM cases GROUP BY mode),
g(metric, minimum) AS (VALUES ('hit_10', 0.5), ('rr', 0.4), ('ndcg', 0.2))
SELECT mode, metric, round(actual + 1e-9, 4) AS actual, CAST(minimum AS DOUBLE) AS minimum, actual >= minimum - 1e-9 AS passed FROM s JOIN g USING (metric)""")
def agg16_release_gates(spark, sf_dir):
    means = _cases(spark, sf_dir).groupBy("mode").agg(*(F.avg(c).alias(c) for c in ("hit_10", "rr", "ndcg")))
    long = means.unpivot("mode", ["hit_10", "rr", "ndcg"], "metric", "actual")
    gates = spark.createDataFrame([("hit_10", 0.5), ("rr", 0.4), ("ndcg", 0.2)], "metric string, minimum double")
    return long.join(F.broadcast(gates), "metric").select("mode", "metric", F.round(F.col("actual") + R.TIE, 4).alias("actual"), "minimum", (F.col("actual") >= F.col("minimum") - 1e-9).alias("passed"))


@query(CASES + " SELECT query_id, mode, pool_hit, hit_10, rr, ndcg, graded_ndcg, first_rank, n_gold FROM cases")
def agg38_case_scores(spark, sf_dir):
    return _cases(spark, sf_dir).select("query_id", "mode", "pool_hit", "hit_10", "rr", "ndcg", "graded_ndcg", "first_rank", "n_gold")


@query(f"WITH {HITS}, {QRELS} SELECT query_id, mode, rank, chunk_id, q.chunk_id IS NOT NULL AS relevant FROM hits h LEFT JOIN qrels q USING (query_id, chunk_id)".replace("q.chunk_id IS", "q.relevance IS"))
def jon02_judge_hits(spark, sf_dir):
    return hits(spark, sf_dir).join(qrels(spark, sf_dir), ["query_id", "chunk_id"], "left").select("query_id", "mode", "rank", "chunk_id", F.col("relevance").isNotNull().alias("relevant"))


@query(PAIR + " SELECT query_id, a, b, ra, rb FROM pair")
def jon03_align_systems(spark, sf_dir):
    return _pair(spark, sf_dir)


@query(CASES + " SELECT query_id, coalesce(max(CASE WHEN mode = 'bm25' THEN rr END), 0) AS bm25, coalesce(max(CASE WHEN mode = 'dense' THEN rr END), 0) AS dense, coalesce(max(CASE WHEN mode = 'hybrid' THEN rr END), 0.0) AS hybrid FROM cases GROUP BY 1")
def jon04_compare_modes(spark, sf_dir):
    return R.compare_modes(_cases(spark, sf_dir), ("bm25", "dense", "hybrid"), "rr")


FUSED = HITS + """, fused AS (SELECT query_id, chunk_id, round(sum(CASE mode WHEN 'dense' THEN 1.0 ELSE 1.1 END / (60 + rank)), 6) AS fusion_score,
  min(CASE mode WHEN 'dense' THEN 0 ELSE 100000 END + rank) AS seen, count(*) AS n_channels FROM hits GROUP BY 1, 2)"""


@query(f"WITH {FUSED} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, seen) AS rank FROM fused")
def txt08_rank_fusion(spark, sf_dir):
    return R.fuse(hits(spark, sf_dir))


@query(f"WITH {FUSED} SELECT query_id, count(*) AS n_merged, count(CASE WHEN n_channels = 2 THEN 1 END) AS n_in_both FROM fused GROUP BY 1")
def jon22_channel_merge(spark, sf_dir):
    return R.fuse(hits(spark, sf_dir)).groupBy("query_id").agg(F.count("*").alias("n_merged"), F.count_if(F.col("n_channels") == 2).alias("n_in_both"))


@query(f"""WITH {HITS}, u AS (SELECT *, CASE mode WHEN 'bm25' THEN 0 ELSE 1 END AS side FROM hits),
s AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY side, rank) AS nth FROM u)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY side, rank) AS rank, chunk_id, mode FROM s WHERE nth = 1""")
def set01_union_hits(spark, sf_dir):
    return R.union_hits(hits(spark, sf_dir), "bm25", "dense")


@query(f"""WITH {HITS}, {QRELS}, pool AS (SELECT DISTINCT query_id, chunk_id FROM hits WHERE rank <= 20), g AS (SELECT query_id, count(*) AS n_gold FROM qrels GROUP BY 1)
SELECT query_id, count(*) AS n_union, count(relevance) AS n_found, round(coalesce(count(relevance) / max(n_gold), 0.0), 4) AS coverage
FROM pool LEFT JOIN qrels USING (query_id, chunk_id) LEFT JOIN g USING (query_id) GROUP BY 1""")
def set02_union_coverage(spark, sf_dir):
    return R.union_coverage(hits(spark, sf_dir), qrels(spark, sf_dir), 20)


@query(CASES + """ SELECT query_id, CASE WHEN b AND d THEN 'both' WHEN b THEN 'bm25_only' WHEN d THEN 'dense_only' ELSE 'neither' END AS label
FROM (SELECT query_id, bool_or(mode = 'bm25' AND pool_hit = 1) AS b, bool_or(mode = 'dense' AND pool_hit = 1) AS d FROM cases GROUP BY 1)""")
def set03_channel_recall(spark, sf_dir):
    return R.channel_recall(_cases(spark, sf_dir))


@query(f"""WITH {HITS}, s AS (SELECT query_id, list_distinct(list(doc) FILTER (WHERE mode = 'bm25')) AS a, list_distinct(list(doc) FILTER (WHERE mode = 'dense')) AS b FROM hits WHERE rank <= 3 GROUP BY 1)
SELECT query_id, NOT list_has_any(coalesce(a, []), coalesce(b, [])) AS disjoint, list_has_all(coalesce(b, []), coalesce(a, [])) AS subset FROM s""")
def set04_disjoint_subset(spark, sf_dir):
    of = lambda m: F.collect_set(F.when(F.col("mode") == m, F.col("doc")))
    sets = hits(spark, sf_dir, 3).groupBy("query_id").agg(of("bm25").alias("a"), of("dense").alias("b"))
    return sets.select("query_id", (~F.arrays_overlap("a", "b")).alias("disjoint"), (F.size(F.array_except("a", "b")) == 0).alias("subset"))
