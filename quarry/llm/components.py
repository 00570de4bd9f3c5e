"""Connected components of an edge table, by repeated minima and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written, written_with


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes in ``edges`` (a, b): the component is its least node.

    In each round a node takes the least label among its own and its neighbours', then the label of
    that label. Minima are pre-aggregated, and the joins are plain ones between written tables, so
    a node with very many edges is split by adaptive execution. Rounds grow with the logarithm of
    the longest chain. Nothing but the count of changes comes to the driver.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")), "labels")
    while True:
        near = (
            both.hint("merge")
            .join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("least"))
        )
        taken = labels.hint("merge").join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "least").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("jumped"))
        after = taken.hint("merge").join(jump, "via").select("node", "old", F.least("via", "jumped").alias("component"))
        after, seen = written_with(after, "labels", changed=F.count_if(F.col("component") != F.col("old")))
        labels = after.select("node", "component")
        if not seen["changed"]:
            return labels
