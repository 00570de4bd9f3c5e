"""Summaries of runs: calls, telemetry, quality, splits, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.ranking import numbered
from quarry.session import written

TRANSIENT = ("timeout", "connection", "rate_limited", "transient_http")


def call_summary(calls: DataFrame) -> DataFrame:
    """Logical calls, attempts and their ratio, outcomes and latency of provider calls."""
    return calls.agg(
        F.count_distinct("logical_call_id").alias("logical_calls"),
        F.count("*").alias("attempts"),
        F.round(F.count("*") / F.count_distinct("logical_call_id"), 4).alias("amplification"),
        F.count_if(F.col("error_class").isNull()).alias("succeeded"),
        F.count_if(F.col("error_class").isin(*TRANSIENT)).alias("transient"),
        F.round(F.sum("latency_ms"), 2).alias("latency_ms"),
    )


def error_class(status: Column, message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(status == 404, "not_found")
        .when(status == 429, "rate_limited")
        .when(status.isin(500, 502, 503, 504), "transient_http")
        .when((status >= 400) & (status < 500), "client_error")
        .when(status >= 500, "http_error")
        .when(low.rlike("timed? ?out"), "timeout")
        .when(low.contains("connection"), "connection")
        .when(low.rlike("429|rate limit|too many requests"), "rate_limited")
        .when(low.rlike("503|502|504"), "transient_http")
        .otherwise("error")
    )


def hash_fraction(salt: str, key: Column) -> Column:
    """The first 48 bits of sha256(salt NUL key) as a fraction."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt + "\0"), key), 256), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def ids_fingerprint(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """sha256 over the sorted distinct ids, in two levels: ids go to 256 buckets by their own hash,
    each bucket is hashed in order, then the buckets in order. No group holds more than a bucket."""
    bucket = F.substring(F.sha2(F.col(column).cast("string"), 256), 1, 2)
    level = rows.select(*by, bucket.alias("bucket"), F.col(column).cast("string").alias("id")).distinct()
    parts = level.groupBy(*by, "bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("id")), "\n"), 256).alias("h"), F.count("*").alias("n"))
    return parts.groupBy(*by).agg(F.sum("n").alias("n_ids"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"]), "\n"), 256).alias("fingerprint"))


def file_fingerprints(rows: DataFrame, name: str) -> DataFrame:
    """(file, n_rows, content_sha256) of the Parquet files behind ``rows``: each row is hashed with its
    place in its file, and a file's hash is that of the sums of four pieces (60 bits each) of its rows'
    hashes, so tasks send sums only. It covers values and their order, not how they are encoded."""
    file = F.regexp_extract("_metadata.file_path", f"({name}[.]parquet(/[^/]+)?)$", 1)
    row = F.concat_ws("\0", F.col("_metadata.row_index").cast("string"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), {"ignoreNullFields": "false"}))
    hashed = rows.select(file.alias("file"), F.sha2(row, 256).alias("h"))
    piece = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    return hashed.groupBy("file").agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws("/", *piece), 256).alias("content_sha256"))


def quality(runs: DataFrame) -> DataFrame:
    """Score and grade of runs with n_missing, n_blocked, n_errors steps."""
    score = F.round(
        (F.greatest(F.lit(0), 100 - 15 * F.col("n_missing") - 10 * F.col("n_blocked")) + F.greatest(F.lit(0), 100 - 20 * F.col("n_errors"))) / 2.0, 1
    )
    s = F.col("score")
    return runs.withColumn("score", score).withColumn("grade", F.when(s >= 90, "A").when(s >= 75, "B").when(s >= 60, "C").otherwise("D"))


def even_sample(keys: DataFrame, column: str, count: int) -> DataFrame:
    """``count`` keys evenly spaced over the sorted distinct ones: places i (n - 1) / (count - 1)."""
    distinct = written(keys.select(column).distinct(), "keys")
    n = distinct.count()
    places = sorted({i * (n - 1) // max(1, count - 1) for i in range(min(count, n))})
    rows = numbered(distinct, column, name="place")
    return rows.where(F.col("place").isin(*places) if places else F.lit(False)).select(column, F.col("place").cast("long").alias("place"))


def lease_audit(events: DataFrame) -> DataFrame:
    """Lease events (doc_id, seq, owner, attempt, at_us, expires, action) with ``accepted``: a renewal or
    finish is accepted if no later attempt has claimed and the owner's own lease hasn't run out."""
    so_far = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("doc_id", "owner", "attempt").orderBy("seq")
    rows = events.withColumns({"newest": F.max("attempt").over(so_far), "lease": F.lag("expires").over(before)})
    ok = (F.col("action") == "claim") | ((F.col("attempt") == F.col("newest")) & (F.col("lease") >= F.col("at_us")))
    return rows.withColumn("accepted", F.coalesce(ok, F.lit(False))).drop("newest", "lease")


def redelivery(events: DataFrame) -> DataFrame:
    """Deliveries (job_id, seq, identity) with ``decision``: run the first, skip its repeats, refuse
    another identity."""
    own = Window.partitionBy("job_id").orderBy("seq")
    rows = events.withColumns({"nth": F.row_number().over(own), "first_identity": F.first("identity").over(own)})
    return rows.withColumn("decision", F.when(F.col("nth") == 1, "run").when(F.col("identity") == F.col("first_identity"), "skip").otherwise("conflict")).drop("nth", "first_identity")


def snapshot_status(snapshots: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Latest snapshot of each ticker with its status: cached within the time to live, else stale."""
    last = snapshots.groupBy("ticker").agg(F.max_by(F.struct("fetched_at", "price"), F.struct("fetched_at", "price")).alias("s"))
    age = F.unix_micros(now) - F.unix_micros(F.col("s.fetched_at"))
    return last.select("ticker", "s.fetched_at", "s.price", F.when(F.col("s.price").isNull(), "failed").when(age <= ttl_seconds * 1_000_000, "cached").otherwise("stale").alias("status"))
