"""Ranks, percentiles and ordered digests of groups of any size: by range partitions where a group is large."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.ranking import numbered
from quarry.session import written

BROADCAST_ROWS = 200_000  # of groups, a few numbers each
FEW_ROWS = 100_000  # of a group that one task sorts
PIECE = 1 << 14  # bytes of ids in one row


def _numbered_groups(rows: DataFrame, by: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with their position in the order of (by, order), and (by, start, n) of the groups."""
    placed = written(numbered(rows, *by, *order, name="_position"), "positions")
    return placed, written(placed.groupBy(*by).agg(F.min("_position").alias("_start"), F.count("*").alias("_n")), "groups")


def ranked_in_groups(rows: DataFrame, by: list[str], order: list[str], name: str = "nth") -> DataFrame:
    """``rows`` with their place in their group, from 0. The group's columns aren't null. Groups of up to
    FEW_ROWS rows are sorted each by itself; with a larger one all are cut into ranges."""
    rows = written(rows, "grouped-rows")
    most = rows.groupBy(*by).count().agg(F.max("count")).first()[0]
    if most is None or most <= FEW_ROWS:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long") - 1)
    placed, starts = _numbered_groups(rows, by, order)
    starts = starts.drop("_n")
    joined = placed.join(F.broadcast(starts), by) if starts.count() <= BROADCAST_ROWS else placed.hint("merge").join(starts, by)
    return joined.select(*rows.columns, (F.col("_position") - F.col("_start")).alias(name))


def values_at(rows: DataFrame, by: list[str], order: list[str], value: str, **places: Column) -> DataFrame:
    """(by, a column for each of ``places``): the value at that place of the group's order, from 0, as
    an expression of the group's size ``n``. Only the rows at those places leave the range partitions."""
    placed, starts = _numbered_groups(rows, by, order)
    wanted = starts.withColumnRenamed("_n", "n").withColumn("_place", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), p.cast("long").alias("at")) for k, p in places.items()))))
    wanted = written(wanted.select(*by, F.col("_place.name").alias("_name"), (F.col("_start") + F.col("_place.at")).alias("_position")), "wanted-places")
    found = wanted.hint("merge").join(placed.select("_position", F.col(value).alias("_value")), "_position")
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("_name") == k, F.col("_value"))).alias(k) for k in places))


def ordered_digests(rows: DataFrame, by: list[str], column: str, separator: str = "\n") -> DataFrame:
    """(by, n_ids, fingerprint): sha256 of a group's distinct ids (as text, in order of code points)
    joined by the separator. Range partitions make pieces of PIECE bytes of the sorted ids; a group's
    pieces are hashed in turn, one at a time. Null ids count for nothing; groups aren't null."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    between = separator.encode()
    keys = F.to_json(F.array(*(F.col(c).cast("string") for c in by)))
    ids = written(rows.select(keys.alias("group"), F.col(column).cast("string").alias("id")).where("id is not null").distinct(), "distinct-ids")

    def pack(batches):
        now, piece, held, seq, out = None, [], 0, 0, []
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        put = lambda part: out.append((now, part, seq, len(piece), between.join(piece)))
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["group", "part", "seq", "n", "piece"])
        part = 0
        for batch in batches:
            for group, key, part in zip(*(c.to_pylist() for c in batch.columns)):
                if group != now or held >= PIECE:
                    if piece:
                        put(part)
                    now, piece, held, seq = group, [], 0, seq + 1
                piece.append(key.encode())
                held += len(piece[-1]) + len(between)
                if len(out) >= 1000:
                    yield flush()
                    out.clear()
        if piece:
            put(part)
        if out:
            yield flush()

    def digest(batches):
        now, sha, count, out = None, None, 0, []
        for batch in batches:
            for group, size, piece in zip(*(batch.column(c).to_pylist() for c in ("group", "n", "piece"))):
                if group != now:
                    if sha:
                        out.append((now, count, sha.hexdigest()))
                    now, sha, count = group, hashlib.sha256(piece), size
                else:
                    sha.update(between + piece)
                    count += size
        if sha:
            out.append((now, count, sha.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), pa.string()))], names=["group", "n_ids", "fingerprint"])

    pieces = ids.repartitionByRange(n, "group", "id").withColumn("part", F.spark_partition_id().cast("long")).sortWithinPartitions("group", "id").mapInArrow(pack, "group string, part long, seq long, n long, piece binary")
    hashed = pieces.repartition(n, "group").sortWithinPartitions("group", "part", "seq").mapInArrow(digest, "group string, n_ids long, fingerprint string")
    types = dict(rows.select(*by).dtypes)
    return hashed.select(*(F.from_json("group", "array<string>")[i].cast(types[c]).alias(c) for i, c in enumerate(by)), "n_ids", "fingerprint")
