"""Running values within a key of any size: range partitions, local windows and the parts' bases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import written


def before(rows: DataFrame, key: str, order: list[str], name: str, columns: dict[str, str], total: Callable = F.sum, joined: Callable[[Column, Column], Column] = lambda a, b: a + b) -> DataFrame:
    """``rows`` with a column for each of ``columns`` (column: name of the new one): the ``total`` of it
    over the rows of the same key that stand earlier in ``order`` (nulls first), 0 for the first.
    ``total`` is an aggregate whose values over parts are ``joined``. A key's rows may lie in many
    partitions: each has a local window, and what stands in earlier parts is added. At most one key
    of a partition has begun in an earlier one, so those bases are no more than the partitions."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [key, *(F.col(c).asc_nulls_first() for c in order)]
    placed = written(rows.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()), name)
    parts = placed.groupBy(key, "_part").agg(*(total(c).alias(c) for c in columns))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(key, "_part", *(total(c).over(earlier).alias(f"_base_{c}") for c in columns), F.row_number().over(Window.partitionBy(key).orderBy("_part")).alias("_nth"))
    bases = written(bases.where("_nth > 1").drop("_nth"), f"{name}-bases")
    here = Window.partitionBy(key, "_part").orderBy(*keys[1:]).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select("*", *(total(c).over(here).alias(f"_local_{c}") for c in columns)).join(F.broadcast(bases), [key, "_part"], "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    return local.select(*rows.columns, *(joined(none(f"_base_{c}"), none(f"_local_{c}")).alias(to) for c, to in columns.items()))
