"""Event-time windows over call events. The same functions serve a stream and a batch replay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import scratch_path, written


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, end, event_type, n, total) of (ts, event_type, value) in tumbling or sliding windows;
    with ``late``, rows behind the watermark are dropped and a stream's state stays bounded."""
    rows = events.withWatermark("ts", late) if late else events
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = rows.groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("w.start", "w.end", "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with no pause of ``gap``."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", "w.start", "w.end", "n")


def latest_snapshots(events: DataFrame, late: str | None = None) -> DataFrame:
    """(ticker, fetched_at, price): the newest snapshot of each ticker."""
    rows = events.withWatermark("fetched_at", late) if late else events
    return rows.groupBy("ticker").agg(F.max_by(F.struct("fetched_at", "price"), F.struct("fetched_at", "price")).alias("s")).select("ticker", "s.*")


class Feed:
    """A stream over rows that arrive in portions: ``step``, a function of the streaming DataFrame, runs on
    each portion in append mode and goes on from its checkpoint, as after a restart. All files are in the
    shared folder, so any executor may take up the state.

    ``progress`` has what Spark reports of each micro-batch: rows dropped as late, rows held as state."""

    def __init__(self, step: Callable[[DataFrame], DataFrame], rows: DataFrame):
        spark = rows.sparkSession
        self.step, self.schema, self.spark = step, rows.schema, spark
        self.folder, self.sink, self.checkpoint = (scratch_path(spark, name) for name in ("feed", "feed-out", "feed-state"))
        self.progress: list[dict] = []

    def take(self, portion: DataFrame, seconds: int = 600) -> None:
        """Hand on one portion, and wait until it has been worked off."""
        portion.write.mode("append").parquet(self.folder)
        stream = self.step(self.spark.readStream.schema(self.schema).parquet(self.folder))
        run = stream.writeStream.format("parquet").outputMode("append").option("path", self.sink).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        try:
            if not run.awaitTermination(seconds):
                raise TimeoutError(f"a portion took more than {seconds} seconds")
            for p in run.recentProgress:
                self.progress.append({"rows": p.numInputRows, "dropped": sum(o.numRowsDroppedByWatermark for o in p.stateOperators), "held": sum(o.numRowsTotal for o in p.stateOperators)})
        finally:
            run.stop()

    def out(self) -> DataFrame:
        """What has been closed by the watermark so far."""
        return self.spark.read.parquet(self.sink)


def fed(rows: DataFrame, step: Callable[[DataFrame], DataFrame], portions: int) -> Feed:
    """A feed that has taken ``rows`` (portion, ...), one portion from 0 after the other."""
    held = written(rows, "portions")
    feed = Feed(step, held.drop("portion"))
    for n in range(portions):
        feed.take(held.where(F.col("portion") == n).drop("portion"))
    return feed
