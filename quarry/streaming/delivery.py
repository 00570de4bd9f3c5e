"""Keyed state over event logs: message delivery, checked revisions, incremental indexing.

Delivery is a state machine per message: reserve counts an attempt, ack ends it, a failure returns
it to the queue or, at the last attempt, to the dead letters, and an idle reservation is taken back
without counting. ``step`` is one event; the stream folds it with state, the batch replays it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.session import scratch_path, written

MAX_ATTEMPTS = 3
IDLE_SECONDS = 10

STATE = "status string, attempt int, reserved_at double"
OUT = "message_id string, status string, attempt int, reason string"
NEW = ("pending", 0, 0.0)


def step(state: tuple, action: str, at: float) -> tuple[tuple, str]:
    """(state, reason) after an event; a refused event leaves the state and gives its reason."""
    status, attempt, reserved = state
    if status == "reserved" and at - reserved >= IDLE_SECONDS and action != "ack":
        status, attempt = "pending", attempt - 1  # taken back: the attempt doesn't count
    if status in ("acked", "dead"):
        return state, "finished"
    if action == "reserve":
        if status == "reserved":
            return (status, attempt, reserved), "already_reserved"
        return ("reserved", attempt + 1, at), "ok"
    if status != "reserved":
        return (status, attempt, reserved), "not_reserved"
    if action == "ack":
        return ("acked", attempt, reserved), "ok"
    if action == "fail":
        return ("dead" if attempt >= MAX_ATTEMPTS else "pending", attempt, 0.0), "ok"
    return (status, attempt, reserved), "unknown_action"


def _fold(state: tuple, rows: pd.DataFrame) -> tuple[tuple, str]:
    reason = "ok"
    for action, at in sorted(zip(rows["action"], rows["at"]), key=lambda r: r[1]):
        state, reason = step(state, action, float(at))
    return state, reason


def delivery_stream(events: DataFrame) -> DataFrame:
    """Current state of each message of a stream (message_id, action, at in seconds), whenever its
    events arrive."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get if state.exists else NEW
        after, reason = _fold(tuple(before), pd.concat(list(batches)))
        state.update(after)
        yield pd.DataFrame({"message_id": [key[0]], "status": [after[0]], "attempt": [after[1]], "reason": [reason]})

    return events.groupBy("message_id").applyInPandasWithState(run, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def delivery_replay(events: DataFrame) -> DataFrame:
    """The same for a finished log. Events come sorted by message and time, a batch of many messages at
    once; of the message that a batch breaks off only the state is carried on."""
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["message_id", "status", "attempt", "reason"])
        current, state, reason, some = None, NEW, "ok", False
        for batch in batches:
            out = []
            for message, action, at in zip(*(c.to_pylist() for c in batch.columns)):
                if not some or message != current:
                    if some:
                        out.append((current, state[0], state[1], reason))
                    current, state, some = message, NEW, True
                state, reason = step(state, action, float("nan") if at is None else at)
            if out:
                yield flush(out)
        if some:
            yield flush([(current, state[0], state[1], reason)])

    rows = events.select(F.col("message_id").cast("string"), "action", F.col("at").cast("double"))
    return rows.repartition("message_id").sortWithinPartitions("message_id", "at").mapInArrow(run, OUT)


def checked_revisions(writes: DataFrame) -> DataFrame:
    """Writes (thread_id, seq, expected) with ``accepted``: a write counts if it expects the current
    revision. The current revision depends on what was accepted before, so a thread's writes are
    folded in order; they are packed as one array a thread."""
    packed = writes.groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("seq", "expected"))).alias("ws"))
    start = F.struct(F.lit(0).cast("long").alias("revision"), F.array().cast("array<struct<seq:bigint,expected:bigint,accepted:boolean>>").alias("out"))

    def fold(s, w):
        ok = w["expected"] == s["revision"]
        row = F.struct(w["seq"].cast("long").alias("seq"), w["expected"].cast("long").alias("expected"), ok.alias("accepted"))
        return F.struct((s["revision"] + ok.cast("long")).alias("revision"), F.concat(s["out"], F.array(row)).alias("out"))

    return packed.select("thread_id", F.inline(F.aggregate("ws", start, fold, lambda s: s["out"])))


class IncrementalIndex:
    """Chunks and vectors of uploads, each (tenant, content) once, under its least doc_id. ``take``
    is a ``foreachBatch`` function: a batch that is delivered again writes the same partition again,
    so a failed batch is simply retried, and uploads that another batch has are left out. Every
    upload is registered, with or without chunks."""

    def __init__(self, path: str, size: int = 900, embed: Callable[[list[str]], list[list[float]]] | None = None):
        self.path, self.size, self.embed = path, size, embed

    def take(self, batch: DataFrame, batch_id: int) -> None:
        from quarry.functions.embedding import embedder
        from quarry.operators.chunking import chunk_pages, paginate

        spark = batch.sparkSession
        content = F.sha2(F.concat_ws("\0", "tenant_id", F.coalesce("text", F.lit(""))), 256)
        rows = batch.withColumn("content", content).groupBy("tenant_id", "content").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
        known = self._stored(spark, "uploads", "content string, tenant_id string, batch long")
        rows = written(rows.hint("merge").join(known.where(F.col("batch") != batch_id).select("tenant_id", "content").distinct(), ["tenant_id", "content"], "left_anti"), "uploads")
        chunks = chunk_pages(paginate(rows.select(F.concat_ws("\0", "tenant_id", "content").alias("doc_id"), "text")), self.size)
        chunks = chunks.select(F.col("doc_id").alias("upload"), "page", "chunk_no", "text", embedder(self.embed)("text").alias("embedding"))
        uploads = rows.select("tenant_id", "doc_id", "content", F.concat_ws("\0", "tenant_id", "content").alias("upload"))
        out = uploads.hint("merge").join(chunks, "upload").drop("upload").withColumn("chunk_id", F.format_string("%s:p%d:c%d", F.col("doc_id").cast("string"), "page", "chunk_no"))
        self._write(out, "chunks", batch_id)
        self._write(uploads.drop("upload"), "uploads", batch_id)  # last: only then the batch counts

    def _write(self, rows: DataFrame, name: str, batch_id: int) -> None:
        rows.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/{name}")

    def _stored(self, spark, name: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)  # nothing has been written yet

    def ready(self, spark) -> DataFrame | None:
        """The chunks, or None before the first batch."""
        try:
            return spark.read.parquet(f"{self.path}/chunks")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None


def replayed_index(spark, uploads: DataFrame) -> DataFrame:
    """The index of one batch of uploads (tenant_id, doc_id, text)."""
    index = IncrementalIndex(scratch_path(spark, "index"))
    index.take(uploads, 0)
    return index.ready(spark)
