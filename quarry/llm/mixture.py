"""Mixing sources to target weights: budgets in words, met by subset sums over document lengths.

Sources, in order of code points (no source last), take the weights in turn and share the words of
all documents. A source's target stops at ``most`` times its size; what is over goes to the others
by weight, until none is above. A source is taken whole as often as its target holds it, and once
more in part: the rest of the target is a budget that a choice of its documents should meet.

The choice needs lengths alone. Documents are counted by source and exact length. All of the budget
but its last words is met by even steps along the sorted lengths, so all lengths have their share; a
bounded knapsack over the documents that are still there fits the rest, by dynamic programming over
sums (each sum remembers the piece that reached it first, pieces are 1, 2, 4 ... documents of a
length). Then the documents of each length with the smallest seeded hashes are taken, as many as
were chosen. A budget of fewer words than LIMIT / 2, or than the longest document, is met by the
knapsack alone, as nearly as can be.

What meets in one task is a source's histogram, a row a length: a source of w words has less than
the root of 2 w of them. The sums in a task go up to LIMIT / 2 words, or those of the longest document,
and twice those more. Ranks of documents are prefix sums over range partitions, so a source or a length of any size is split.

A null text has no words. A null source is a source of its own. Rows are told apart by the hash of
doc_id; of rows that agree in all of it any may be taken, the result is the same. Documents without
words are taken 0 words. Other columns are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import byte_view, only, released, slices, table, written
from quarry.operators.ranking import numbered

LIMIT = 1 << 16  # half as many words are left to the knapsack
SOURCE = ["unnamed", "source"]  # "" and unnamed: no source


def word_counts(column: pa.Array) -> np.ndarray:
    """Runs of bytes that aren't space or tab to carriage return, in each text."""
    flat, offsets = byte_view(column)
    word = ~((flat == 0x20) | ((flat >= 9) & (flat <= 13)))
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    starts[first] = word[first]  # a text's first byte has nothing before it
    before = np.concatenate([[0], np.cumsum(starts, dtype=np.int64)])
    return before[offsets[1:]] - before[offsets[:-1]]


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, unnamed, source, size)"""

    @released()
    def run(batches):
        for batch in slices(batches):
            source = batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), source.is_null(), source.fill_null(""), pa.array(word_counts(batch.column(2)))], names=["doc_id", *SOURCE, "size"])

    return only(docs, doc_id="long", source="string", text="string").mapInArrow(run, "doc_id long, unnamed boolean, source string, size long")


def targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(unnamed, source, source_size, target, stopped) of sources (unnamed, source, source_size). Each
    round gives the sources that aren't stopped what is left, by weight, and stops those that would
    have too much; a round is two sums over a row a source."""
    shares = F.array(*map(F.lit, weights))
    rows = written(numbered(sources, *SOURCE).withColumn("weight", F.get(shares, (F.col("position") % len(weights)).cast("int")).cast("long")), "sources")
    exact = lambda c: F.col(c).cast("decimal(38,0)")  # noqa: E731  products of two counts
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    stopped, before = F.lit(False), -1
    while True:
        left, weight, now = rows.agg(
            F.sum(F.when(stopped, -most * F.col("source_size")).otherwise(0)), F.sum(F.when(stopped, 0).otherwise(F.col("weight"))), F.count_if(stopped)
        ).first()
        left, weight = total + (left or 0), weight or 0
        if now == before or not weight:
            break
        before = now
        stopped = exact("source_size") * most * weight < exact("weight") * left
    share = F.col("weight").cast("double") * float(left) / float(weight) if weight else F.lit(0.0)
    most_words = (most * F.col("source_size")).cast("double")
    return rows.select(*SOURCE, "source_size", stopped.alias("stopped"), F.when(stopped, most_words).otherwise(F.least(share, most_words)).alias("target"))


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: float, most: int) -> np.ndarray:
    """How many of ``counts`` documents of each length to take, so that their sum is as near to the
    budget as any sum up to ``most`` is."""
    taken = np.zeros(len(lengths), np.int64)
    reached, by, pieces = np.zeros(most + 1, bool), np.full(most + 1, -1, np.int64), []
    reached[0] = True
    exact = int(budget) if float(budget).is_integer() and budget <= most else -1
    for i in np.argsort(lengths, kind="stable")[::-1].tolist():
        length, left, piece = int(lengths[i]), int(min(counts[i], most // max(1, lengths[i]))), 1
        while left > 0 and not (exact >= 0 and reached[exact]):
            piece = min(piece, left)
            step = piece * length
            if step > most:
                break
            new = reached[: most + 1 - step] & ~reached[step:]
            at = np.flatnonzero(new) + step
            reached[at] = True
            by[at] = len(pieces)
            pieces.append((i, piece))
            left, piece = left - piece, piece * 2
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        i, piece = pieces[by[at]]
        taken[i] += piece
        at -= piece * int(lengths[i])
    return taken


def fit(lengths: np.ndarray, counts: np.ndarray, budget: float, limit: int = LIMIT) -> np.ndarray:
    """How many of ``counts`` documents of each length to take for ``budget`` words, at most all."""
    lengths, counts = lengths.astype(np.int64), np.where(lengths > 0, counts, 0).astype(np.int64)
    total, longest = int(np.dot(lengths, counts)), int(lengths[counts > 0].max(initial=0))
    if not total or budget <= 0:
        return np.zeros(len(lengths), np.int64)
    order = np.argsort(lengths, kind="stable")
    kept = max(limit // 2, longest)  # for the knapsack; even steps along sorted lengths miss a share by one document at most
    even = np.floor(np.cumsum(counts[order]) * (max(0.0, budget - kept) / total)).astype(np.int64)
    taken = np.zeros(len(lengths), np.int64)
    taken[order] = np.minimum(np.diff(even, prepend=0), counts[order])
    left = budget - int(np.dot(lengths, taken))
    return taken + knapsack(lengths, counts - taken, left, int(left) + longest)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 42, limit: int = LIMIT) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): how often the mix has each document."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(sizes(docs).withColumn("draw", F.xxhash64(F.lit(seed), "doc_id")), "sizes")
    order = [*SOURCE, "size", "draw", "doc_id"]
    placed = written(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    parts = written(placed.groupBy(*SOURCE, "size", "part").agg(F.count("*").alias("here")), "mix-parts")
    sources = targets(parts.groupBy(*SOURCE).agg(F.sum(F.col("size") * F.col("here")).alias("source_size")), weights, most)
    sources = sources.withColumn("whole", F.when(F.col("stopped"), most).when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long"))
    sources = written(sources, "mix-targets")
    lengths = parts.groupBy(*SOURCE, "size").agg(F.sum("here").alias("n"))
    lengths = lengths.hint("merge").join(sources, SOURCE)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        target, size, whole = rows[["target", "source_size", "whole"]].iloc[0]
        out = rows[[*SOURCE, "size", "source_size", "target", "whole"]].copy()
        out["more"] = 0 if whole >= most else fit(rows["size"].to_numpy(), rows["n"].to_numpy(), target - whole * size, limit)
        return out

    plan = written(lengths.groupBy(*SOURCE).applyInPandas(choose, "unnamed boolean, source string, size long, source_size long, target double, whole long, more long"), "mix-plan")
    before = F.coalesce(F.sum("here").over(Window.partitionBy(*SOURCE, "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    quota = written(parts.withColumn("before", before).hint("merge").join(plan, [*SOURCE, "size"]), "mix-quota")
    own = [*SOURCE, "size", "part"]
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy(*own).orderBy("draw", "doc_id")))
    copies = F.col("whole") + (F.col("before") + F.col("rank") <= F.col("more")).cast("long")
    return (
        ranked.hint("merge")
        .join(quota, own)
        .select("doc_id", F.when(~F.col("unnamed"), F.col("source")).alias("source"), "size", "source_size", "target", F.when(F.col("size") > 0, copies).otherwise(0).cast("long").alias("copies"))
    )


def op12_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
