"""Small helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import scratch_path, shared_dir, table, written, written_with  # noqa: F401

WORD = re.compile(r"\w+")
SLICE_BYTES = 1 << 20  # of text that a task holds in numpy form at once


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each part holds about ``most`` bytes of ``text``; a longer text
    stands alone, whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        lengths = np.asarray(pc.binary_length(column).fill_null(0), dtype=np.int64)
        part = (np.cumsum(lengths) - lengths) // most
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def released(*modules: str) -> Callable:
    """Decorates a function of Arrow batches: when a task ends, the ``_state`` of the named modules
    is emptied and free memory goes back to the system. Python workers are used again by later
    stages, so what one of them keeps is missing to all others."""

    def around(run):
        @functools.wraps(run)
        def ending(batches):
            try:
                yield from run(batches)
            finally:
                for name in modules:
                    if name in sys.modules:
                        sys.modules[name]._state.clear()
                pa.default_memory_pool().release_unused()
                trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
                if trim:
                    trim(0)

        return ending

    return around


def forget_shuffles(spark: SparkSession) -> None:
    """Let the shuffle files of finished jobs go now. Spark drops them when the driver's heap is
    collected, which may not happen before the next job has written as much again."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and the offsets of its values (null: empty)."""
    data = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(data.buffers()[1], dtype=np.int64)[data.offset : data.offset + len(data) + 1]
    whole = data.buffers()[2]
    flat = np.frombuffer(whole, dtype=np.uint8) if whole is not None and whole.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def run_starts(sorted_values: np.ndarray) -> np.ndarray:
    """True where a run of equal values starts."""
    first = np.ones(len(sorted_values), dtype=bool)
    first[1:] = sorted_values[1:] != sorted_values[:-1]
    return first


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null id: 0)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus, F.lit(0))


def only(df: DataFrame, **types: str) -> DataFrame:
    """The named columns alone, cast; whatever else the caller's table holds is left out, so no
    name of it can clash with ours."""
    return df.select(*(F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)
