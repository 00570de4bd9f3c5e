"""The best documents of many queries over postings with impacts, without scoring most pairs.

A posting (scope, term, key, impact) says what a term adds to a document's score, a query's term
(query_id, scope, term, weight) how much of that counts; impacts and weights are positive. Postings
fall into blocks by impact, so a table of (term, block) with counts and bounds, small against the
postings, tells what a block can add at most.

1. A threshold that k documents of a query reach: the k-th impact of one of its terms, by the
   counts, or the k-th sum over its rarest terms.
2. A query's terms stand in order of what they can add. A document whose first term in that order is
   the i-th can't have more than that term's block and the terms behind it; blocks with which the
   threshold can't be met make no candidates. Frequent terms stand last, so nearly all of their
   blocks are left out.
3. Candidates that can still reach the k-th sum so far get the impacts of the blocks left out, by
   looking up (term, document).

No document that belongs to the k best is lost, ties included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import written

DIRECT_PAIRS = 5_000_000  # of postings and query terms that are scored without thresholds
SEEDS = 20  # times k: postings of a query's rarest terms that thresholds are found with
SLIP = 2e-4  # scores are rounded to four places
TERM = ["scope", "term"]


def _kth(sums: DataFrame, value: str, k: int) -> DataFrame:
    """(query_id, at_least): the k-th largest value of a query."""
    order = Window.partitionBy("query_id").orderBy(F.desc(value))
    return sums.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k).where(F.col("_place") == k).select("query_id", F.col(value).alias("at_least"))


def _scored(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("query_id", "key").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))


def candidates(terms: DataFrame, postings: DataFrame, k: int, width: float = 0.25, more: float = 0.0, most: float | None = None, direct: int = DIRECT_PAIRS, counted: dict | None = None) -> DataFrame:
    """(query_id, key, score): the k best documents of each query and some others, with whole scores.
    ``more`` may be added to any score later, and scores may be cut at ``most``; both are allowed
    for. ``counted`` gets the numbers of pairs: those of all postings with query terms, and those met."""
    post = written(postings.withColumn("block", F.floor(F.col("impact") / width).cast("int")), "impacts")
    blocks = post.groupBy(*TERM, "block").agg(F.max("impact").alias("high"), F.min("impact").alias("low"), F.count("*").alias("n"))
    per = written(terms.hint("merge").join(written(blocks, "impact-blocks"), TERM), "query-blocks")
    pairs = per.agg(F.sum("n")).first()[0] or 0
    if counted is not None:
        counted.update(all=pairs, met=pairs)
    if pairs <= direct:
        return _scored(terms.hint("merge").join(post, TERM))

    own = ["query_id", *TERM, "weight"]
    downwards = Window.partitionBy("query_id", *TERM).orderBy(F.desc("block"))
    reach = per.withColumn("seen", F.sum("n").over(downwards)).where((F.col("seen") >= k) & (F.col("seen") - F.col("n") < k))
    alone = reach.select("query_id", (F.col("weight") * F.col("low")).alias("at_least"))
    tops = per.groupBy(*own).agg(F.max(F.col("high") * F.col("weight")).alias("top"), F.sum("n").alias("df"))
    rare = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("query_id").orderBy(F.desc("top"), "df", "term").rowsBetween(1, Window.unboundedFollowing)
    tops = written(tops.withColumns({"seen": F.sum("df").over(rare), "rest": F.coalesce(F.sum("top").over(after), F.lit(0.0))}), "query-tops")
    seeds = tops.where(F.col("seen") <= SEEDS * k).select(*own).hint("merge").join(post, TERM)
    found = alone.unionByName(_kth(_scored(seeds), "score", k)).groupBy("query_id").agg(F.max("at_least").alias("at_least"))
    found = written(found, "thresholds")

    def enough(bound, at_least):
        goal = F.coalesce(at_least, F.lit(float("-inf")))
        return bound + more >= (goal if most is None else F.least(goal, F.lit(float(most)))) - SLIP

    ranked = per.hint("merge").join(tops.select("query_id", *TERM, "rest"), ["query_id", *TERM]).hint("merge").join(found, "query_id", "left")
    ranked = written(ranked.withColumn("open", enough(F.col("weight") * F.col("high") + F.col("rest"), F.col("at_least"))), "query-open")
    # a term's open blocks are its upper ones: what is left of it is below `floor`
    floors = ranked.groupBy(*own).agg(F.min(F.when(F.col("open"), F.col("block"))).alias("floor"), F.coalesce(F.max(F.when(~F.col("open"), F.col("weight") * F.col("high"))), F.lit(0.0)).alias("left"))
    floors = written(floors, "query-floors")
    partial = written(_scored(ranked.where("open").select(*own, "block").hint("merge").join(post, [*TERM, "block"])), "partial")
    left = floors.groupBy("query_id").agg(F.sum("left").alias("left"))
    goal = found.unionByName(_kth(partial, "score", k)).groupBy("query_id").agg(F.max("at_least").alias("at_least"))
    near = partial.hint("merge").join(written(left.hint("merge").join(goal, "query_id", "left"), "goals"), "query_id")
    near = written(near.where(enough(F.col("score") + F.col("left"), F.col("at_least"))).select("query_id", "key", "score"), "near")
    shut = floors.where("left > 0").select(*own, "floor")
    looked = near.select("query_id", "key").hint("merge").join(shut, "query_id").hint("merge").join(post, [*TERM, "key"])
    looked = looked.where(F.col("floor").isNull() | (F.col("block") < F.col("floor"))).select("query_id", "key", (F.col("weight") * F.col("impact")).alias("score"))
    if counted is not None:
        looked = written(looked, "looked")
        counted["met"] = (ranked.where("open").agg(F.sum("n")).first()[0] or 0) + (seeds.count()) + looked.count()
    return near.unionByName(looked).groupBy("query_id", "key").agg(F.sum("score").alias("score"))
