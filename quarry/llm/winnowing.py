"""Document fingerprints by winnowing.

Every run of ``k`` code points has a rolling hash; of each ``window`` successive hashes the smallest
is selected, the rightmost of equal ones, and its position kept. Two texts that share a run of
``window + k - 1`` code points share a selected hash. A text of fewer than ``k`` code points is one
gram; one with fewer than ``window`` grams is one window. The likeness of two texts is the Jaccard
coefficient of their sets of selected hashes (two empty texts: 1, an empty and another: 0).

Documents stand in ascending order of (doc_id, text), a null id first; a null text is empty;
repeated rows each keep their place and are each other's neighbours. The document after the last is
the first. A lone document is its own successor. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import code_points, mix64, only, slices, table

K = 24
WINDOW = 40
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of all runs of k code points: a polynomial in BASE modulo 2^64, made by
    doubling (the hash of 2j points from two of j), then scrambled."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(k, n)
    single = mix64(points.astype(np.uint64) + np.uint64(1))
    width, power = 1, BASE
    doubled, done, done_width = single, None, 0
    with np.errstate(over="ignore"):
        while True:
            if k & width:
                if done is None:
                    done, done_width = doubled, width
                else:  # what is done stands left of the next part
                    m = n - done_width - width + 1
                    done, done_width = done[:m] * power + doubled[done_width : done_width + m], done_width + width
            if width * 2 > k:
                return mix64(done) >> np.uint64(32)
            m = n - 2 * width + 1
            doubled = doubled[:m] * power + doubled[width : width + m]
            width, power = width * 2, power * power


def winnow(points: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Selected hashes and their positions, in order of position."""
    hashes = gram_hashes(points, k)
    n = len(hashes)
    if n == 0:
        return hashes, np.zeros(0, np.int64)
    window = min(window, n)
    # the smaller key is the smaller hash, and of equal ones the one further right
    key = (hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - (np.arange(n, dtype=np.uint64)))
    least, width = key, 1
    while width * 2 <= window:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < window:
        least = np.minimum(least[: n - window + 1], least[window - width : window - width + n - window + 1])
    chosen = least[np.concatenate([[True], least[1:] != least[:-1]])]
    positions = (np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))).astype(np.int64)
    return hashes[positions], positions


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard coefficient of two arrays of distinct values."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _text_of(points: np.ndarray) -> bytes:
    return points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")


def fingerprint_text(hashes: np.ndarray) -> str:
    """Eight hexadecimal digits for each selected hash, in order of position."""
    return hashes.astype(">u4").tobytes().hex()


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_order(docs: DataFrame) -> DataFrame:
    """(bucket, lead, doc_id, text): range buckets of doc_id in ascending order, numbered from 0
    (four for each shuffle partition), each with the rows that start the following bucket (of the last: the first) added as ``lead``.
    Nothing but a doc_id for each bucket comes to the driver."""
    spark = docs.sparkSession
    rows = only(docs, doc_id="long", text="string")
    first = (
        rows.select("doc_id")
        .repartitionByRange(4 * _partitions(spark), F.col("doc_id").asc_nulls_first())
        .groupBy(F.spark_partition_id().alias("part"))
        .agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("null"))
    )
    starts = sorted(-(2**63) if r.null else r.least for r in first.collect())
    if not starts:
        return rows.select(F.lit(0).alias("bucket"), F.lit(False).alias("lead"), "doc_id", "text")
    bounds = np.array(starts, dtype=np.int64)
    last = len(starts) - 1

    def place(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(-(2**63)), dtype=np.int64)
            at = np.searchsorted(bounds, ids, side="right") - 1
            starting = bounds[np.maximum(at, 0)] == ids
            for lead, bucket, mask in ((False, at, None), (True, np.where(at == 0, last, at - 1), starting)):
                part = batch if mask is None else batch.filter(pa.array(mask))
                bucket = bucket if mask is None else bucket[mask]
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket.astype(np.int32)), pa.array(np.full(part.num_rows, lead)), *part.columns], names=["bucket", "lead", "doc_id", "text"]
                    )

    return rows.mapInArrow(place, "bucket int, lead boolean, doc_id long, text string")


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """For each document its winnowed fingerprint, that of its edited text (its last half replaced
    by the start of the next document) and their likenesses; ``positions`` has the selected places.
    """

    def scan(batches):
        held = None  # a document that waits for the next one
        out: list[tuple] = []

        def flush():
            cols = list(zip(*out))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.list_(pa.int32()))
            names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_selected", "positions")
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=list(names))
            out.clear()
            return batch

        def finish(doc, following):
            _, doc_id, points, hashes, positions, distinct = doc
            take = min(len(points) // 2, len(following[2]))
            edited = np.concatenate([points[: len(points) - len(points) // 2], following[2][:take]])
            changed, _ = winnow(edited, k, window)
            out.append(
                (
                    doc_id,
                    len(points),
                    hashlib.sha256(_text_of(edited)).hexdigest(),
                    fingerprint_text(hashes),
                    fingerprint_text(changed),
                    likeness(distinct, np.unique(changed)),
                    likeness(distinct, following[5]),
                    len(hashes),
                    positions.astype(np.int32),
                )
            )

        led = None  # the bucket whose lead row has been used
        for batch in slices(batches, "text"):
            for bucket, lead, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if lead and led == bucket:
                    continue
                points = code_points(text or "")
                hashes, positions = winnow(points, k, window)
                doc = (bucket, doc_id, points, hashes, positions, np.unique(hashes))
                if held is not None and held[0] == bucket:
                    finish(held, doc)
                held = None if lead else doc
                led = bucket if lead else led
                if len(out) >= 256:
                    yield flush()
        if out:
            yield flush()

    # a bucket goes to one task, which sees its documents in order and then the next bucket's first
    order = [F.col("bucket"), F.col("lead"), F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    return (
        in_order(docs)
        .withColumn("text", F.coalesce("text", F.lit("")))
        .repartition(_partitions(docs.sparkSession), "bucket")
        .sortWithinPartitions(*order)
        .mapInArrow(
            scan,
            "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_selected int, positions array<int>",
        )
    )


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents")).drop("positions")
