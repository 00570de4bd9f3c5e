"""Ranked lists against judgements: metrics per case, summaries, comparisons of systems.

A ranked list is a table (query_id, mode, rank, chunk_id, ...), judgements are (query_id, chunk_id,
relevance). Rank is a column; every order ends in a unique key. Lists come from one shuffle on the
case, and all metrics of a case from one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import written

TIE = 1e-9  # added to means of rounded values before they are rounded: an exact half goes up everywhere


def numbered(rows: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """``rows`` with their places in a total order, from 0. Rows are sorted by range and numbered within
    each range; the ranges' bases are prefix sums over a row a range, so no task holds all rows."""
    spark = rows.sparkSession
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    names = [f"_key{i}" for i in range(len(keys))]
    keyed = rows.select("*", *(k.alias(n) for k, n in zip(keys, names)))
    sorted_ = written(keyed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *names).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = sorted_.groupBy("_range").agg(F.count("*").alias("n"))
    bases = sizes.select("_range", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # a row a range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*names)) - 1
    return sorted_.withColumn("_place", place).hint("merge").join(bases, "_range").select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("_base") + F.col("_place")).cast("long").alias(name))


def judged(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """Hits with ``relevance`` (0 if not judged) and ``first``: false for a repeated chunk."""
    seen = Window.partitionBy("query_id", "mode", "chunk_id").orderBy("rank")
    return hits.join(qrels, ["query_id", "chunk_id"], "left").withColumns({"relevance": F.coalesce("relevance", F.lit(0)), "first": F.row_number().over(seen) == 1})


def _gain(relevance: Column, rank: Column, graded: bool) -> Column:
    return (F.pow(2.0, relevance) - 1 if graded else F.lit(1.0)) / F.log2(rank + 1)


def gold_counts(qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, n_gold, ideal, graded_ideal): the best DCG within k."""
    best = qrels.where("relevance > 0").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "chunk_id")))
    within = F.col("place") <= k
    return best.groupBy("query_id").agg(
        F.count("*").alias("n_gold"),
        F.sum(F.when(within, _gain(F.col("relevance"), F.col("place"), False))).alias("ideal"),
        F.sum(F.when(within, _gain(F.col("relevance"), F.col("place"), True))).alias("graded_ideal"),
    )


def score_cases(hits: DataFrame, qrels: DataFrame, ks=(1, 3, 5, 10), k: int = 10, empty_recall: float = 0.0) -> DataFrame:
    """One row per (query_id, mode): hit@k and recall@k for each of ks, reciprocal rank, first gold
    rank (0: none), binary and graded nDCG@k, pool hit. Without gold a case has hits of 0 and a
    recall of ``empty_recall``."""
    right = F.col("relevance") > 0
    rows = judged(hits, qrels)
    found = rows.groupBy("query_id", "mode").agg(
        *(F.max(F.when(right & (F.col("rank") <= n), 1).otherwise(0)).cast("long").alias(f"hit_{n}") for n in ks),
        *(F.count_if(right & F.col("first") & (F.col("rank") <= n)).alias(f"found_{n}") for n in ks),
        F.coalesce(F.min(F.when(right, F.col("rank"))), F.lit(0)).cast("long").alias("first_rank"),
        F.sum(F.when(right & F.col("first") & (F.col("rank") <= k), _gain(F.col("relevance"), F.col("rank"), False)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(right & F.col("first") & (F.col("rank") <= k), _gain(F.col("relevance"), F.col("rank"), True)).otherwise(0.0)).alias("graded_dcg"),
        F.max(right.cast("long")).alias("pool_hit"),
    )
    cases = found.join(gold_counts(qrels, k), "query_id", "left")
    return cases.select(
        "query_id",
        "mode",
        *(f"hit_{n}" for n in ks),
        *(F.round(F.coalesce(F.col(f"found_{n}") / F.col("n_gold"), F.lit(empty_recall)), 4).alias(f"recall_{n}") for n in ks),
        F.round(F.when(F.col("first_rank") > 0, 1.0 / F.col("first_rank")).otherwise(0.0), 4).alias("rr"),
        "first_rank",
        F.round(F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)), 4).alias("ndcg"),
        F.round(F.coalesce(F.col("graded_dcg") / F.col("graded_ideal"), F.lit(0.0)), 4).alias("graded_ndcg"),
        "pool_hit",
        F.coalesce("n_gold", F.lit(0)).alias("n_gold"),
    )


def summarize(cases: DataFrame, *by: str) -> DataFrame:
    """Means of the case metrics, rounded once to four digits."""
    means = ("hit_1", "hit_3", "hit_5", "hit_10", "recall_10", "rr", "ndcg", "graded_ndcg")
    return cases.groupBy(*by).agg(F.count("*").alias("n_cases"), *(F.round(F.avg(c) + TIE, 4).alias(c) for c in means))


def collapse_pages(hits: DataFrame, k: int = 10) -> DataFrame:
    """Best hit of each page (a hit without a page stays), ranked anew, first k."""
    place = Window.partitionBy("query_id", "mode", "doc", "page").orderBy("rank")
    again = Window.partitionBy("query_id", "mode").orderBy("rank")
    kept = hits.withColumn("nth", F.row_number().over(place)).where("nth = 1 or page is null").drop("nth")
    return kept.withColumn("page_rank", F.row_number().over(again).cast("long")).where(F.col("page_rank") <= k)


def page_occupancy(hits: DataFrame, k: int = 10) -> DataFrame:
    """Unique pages, identified hits and repeated ones among the first k."""
    known = F.col("page").isNotNull()
    top = hits.where(F.col("rank") <= k)
    out = top.groupBy("query_id", "mode").agg(
        F.count("*").alias("n_hits"), F.count_if(known).alias("n_identified"), F.count_distinct(F.when(known, F.struct("doc", "page"))).alias("n_pages")
    )
    return out.withColumns({"coverage": F.round(F.col("n_identified") / F.col("n_hits"), 4), "duplicates": F.col("n_identified") - F.col("n_pages")})


def top_k(scored: DataFrame, k: int, key: str = "query_id", score: str = "score", tie: str = "chunk_id") -> DataFrame:
    """The k best rows of each key; the limit goes below the shuffle."""
    order = Window.partitionBy(key).orderBy(F.desc(score), tie)
    return scored.withColumn("top_rank", F.row_number().over(order).cast("long")).where(F.col("top_rank") <= k)


ARMS = (("A_prod", 20, False), ("B_wide", 50, False), ("R_page", 50, True))


def arm_pools(hits: DataFrame, arms=ARMS, final_k: int = 20) -> DataFrame:
    """Every arm's pool from one retrieval: its window of the list, as chunks or as unique pages."""
    spark = hits.sparkSession
    spec = spark.createDataFrame(list(arms), "arm string, window int, by_page boolean")
    rows = hits.crossJoin(F.broadcast(spec)).where(F.col("rank") <= F.col("window"))  # a row an arm
    page = Window.partitionBy("query_id", "mode", "arm", "doc", "page").orderBy("rank")
    again = Window.partitionBy("query_id", "mode", "arm").orderBy("rank")
    kept = rows.withColumn("nth", F.row_number().over(page)).where("not by_page or nth = 1")
    return kept.withColumn("pool_rank", F.row_number().over(again).cast("long")).where(F.col("pool_rank") <= final_k).drop("nth", "window", "by_page")


def rank_movement(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, before, after, movement) of first gold ranks; 0 stands for not found."""
    a, b = F.col("before"), F.col("after")
    return (
        before.select("query_id", F.col("first_rank").alias("before"))
        .join(after.select("query_id", F.col("first_rank").alias("after")), "query_id")
        .withColumn(
            "movement",
            F.when((a == 0) & (b == 0), "never").when(a == 0, "improved").when(b == 0, "degraded").when(b < a, "improved").when(b > a, "degraded").otherwise("tied"),
        )
    )


def compare_modes(cases: DataFrame, modes, metric: str) -> DataFrame:
    """A case a row and a mode a column; a mode that lacks the case counts 0."""
    return cases.groupBy("query_id").pivot("mode", list(modes)).agg(F.first(metric)).na.fill(0)


def mcnemar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of the 2x2 table of two 0/1 columns and the exact two-sided p-value. The binomial
    tail is a running term of at most min(b, c) steps, in logarithms."""
    counts = pairs.agg(
        F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias("both"),
        F.count_if((F.col(a) == 1) & (F.col(b) == 0)).alias("only_a"),
        F.count_if((F.col(a) == 0) & (F.col(b) == 1)).alias("only_b"),
        F.count_if((F.col(a) == 0) & (F.col(b) == 0)).alias("neither"),
    )
    n, k = F.col("only_a") + F.col("only_b"), F.least("only_a", "only_b")
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.exp(-n * F.log(F.lit(2.0))).alias("total"))
    step = lambda s, i: F.struct((s["term"] + F.log((n - i + 1) / i)).alias("term"), (s["total"] + F.exp(s["term"] + F.log((n - i + 1) / i))).alias("total"))
    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, step)["total"]
    return counts.withColumn("p_value", F.round(F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)), 4))


BROADCAST_VALUES = 2_000_000  # rows of a position and a few numbers


def bootstrap_means(values: DataFrame, resamples: int, seed: int, *columns: str, most: int = BROADCAST_VALUES) -> DataFrame:
    """(resample, mean of each column) of (position from 0, columns). Draw i of resample b is the
    row whose position is a hash of (seed, b, i) modulo n, so any engine draws the same rows.

    Draws are made in blocks, a task each or a few. Up to ``most`` values are broadcast: a draw meets
    its value where it is made, and what is shuffled are a block's partial sums, a row a resample.
    More values meet the draws in a shuffle, counted before by resample and position."""
    n = values.count()
    spark = values.sparkSession
    block = max(1, min(n, 100_000))
    blocks = -(-n // block) if n else 0
    made = spark.range(0, resamples * blocks, 1, max(1, min(resamples * blocks, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    first = (F.col("id") % max(blocks, 1)) * block
    draws = made.select(F.floor(F.col("id") / max(blocks, 1)).alias("resample"), F.explode(F.sequence(first, F.least(first + block, F.lit(n)) - 1)).alias("i"))
    slot = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), "resample", "i")), 1, 12), 16, 10).cast("long") % max(n, 1)
    placed = draws.select("resample", slot.alias("position"))
    own = values.select("position", *columns)
    if n <= most:
        return placed.join(F.broadcast(own), "position").groupBy("resample").agg(*(F.avg(c).alias(c) for c in columns))
    counted = placed.groupBy("resample", "position").agg(F.count("*").alias("times")).hint("merge").join(own, "position")
    mean = lambda c: F.sum(F.col(c) * F.col("times")) / F.sum(F.when(F.col(c).isNotNull(), F.col("times")))
    return counted.groupBy("resample").agg(*(mean(c).alias(c) for c in columns))


def percentile_bounds(means: DataFrame, column: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Nearest-rank bounds: the value at ceil(q n)."""
    return means.agg(F.round(F.expr(f"percentile_disc({low}) within group (order by {column})"), 4).alias("low"), F.round(F.expr(f"percentile_disc({high}) within group (order by {column})"), 4).alias("high"))


def channel_recall(cases: DataFrame) -> DataFrame:
    """(query_id, label): whether both, one or neither channel found gold."""
    one = F.bool_or((F.col("mode") == "bm25") & (F.col("pool_hit") == 1))
    two = F.bool_or((F.col("mode") == "dense") & (F.col("pool_hit") == 1))
    got = cases.groupBy("query_id").agg(one.alias("b"), two.alias("d"))
    label = F.when(F.col("b") & F.col("d"), "both").when(F.col("b"), "bm25_only").when(F.col("d"), "dense_only").otherwise("neither")
    return got.select("query_id", label.alias("label"))


def union_coverage(hits: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """What either channel has within k, and the share of gold in it."""
    pool = hits.where(F.col("rank") <= k).select("query_id", "chunk_id").distinct()
    gold = qrels.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    found = pool.join(qrels, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.count("*").alias("n_union"), F.count("relevance").alias("n_found"))
    return found.join(gold, "query_id", "left").select("query_id", "n_union", "n_found", F.round(F.coalesce(F.col("n_found") / F.col("n_gold"), F.lit(0.0)), 4).alias("coverage"))


def union_hits(hits: DataFrame, first: str, second: str) -> DataFrame:
    """Distinct union of two lists in order: all of the first, then what the second adds."""
    side = F.when(F.col("mode") == first, 0).otherwise(1)
    rows = hits.where(F.col("mode").isin(first, second)).withColumn("side", side)
    seen = Window.partitionBy("query_id", "chunk_id").orderBy("side", "rank")
    place = Window.partitionBy("query_id").orderBy("side", "rank")
    return rows.withColumn("nth", F.row_number().over(seen)).where("nth = 1").select("query_id", F.row_number().over(place).cast("long").alias("rank"), "chunk_id", "mode")


def failure_class(cases: DataFrame) -> DataFrame:
    """Ordered classes of a case by its first gold rank and pool."""
    r = F.col("first_rank")
    label = (
        F.when(F.col("n_gold") == 0, "invalid_gold")
        .when((r >= 1) & (r <= 10), "hit_at_10")
        .when((r >= 11) & (r <= 20), "gold_rank_11_20")
        .when((r >= 21) & (r <= 30), "gold_rank_21_30")
        .when((r >= 31) & (r <= 50), "gold_rank_31_50")
        .otherwise("gold_not_in_top50")
    )
    return cases.select("query_id", "mode", "first_rank", label.alias("failure"))


def fuse(hits: DataFrame, weights: dict[str, float] | None = None, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: the sum of weight / (k + rank) over channels, rounded once, ranked by
    score and, in ties, by the best place (channel order, rank)."""
    weights = weights or {"dense": 1.0, "bm25": 1.1}
    weight, order = F.lit(1.0), F.lit(len(weights))
    for i, (mode, w) in enumerate(weights.items()):
        weight, order = F.when(F.col("mode") == mode, w).otherwise(weight), F.when(F.col("mode") == mode, i).otherwise(order)
    fused = hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(weight / (k + F.col("rank"))), 6).alias("fusion_score"), F.min(order * 100000 + F.col("rank")).cast("long").alias("seen"), F.count("*").alias("n_channels"))
    place = Window.partitionBy("query_id").orderBy(F.desc("fusion_score"), "seen")
    return fused.withColumn("rank", F.row_number().over(place).cast("long"))
