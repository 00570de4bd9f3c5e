"""Pluggable functions: embedders, rerankers, and table functions for SQL."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import arrow_udf

DIMENSION = 384
TEXTS = 256  # of an Arrow batch, embedded at a time


_TOKEN = re.compile("[a-zA-Z0-9\u4e00-\u9fff]+")


def hash_embedding(text: str, dimension: int = DIMENSION) -> list[float]:
    """A deterministic unit vector: the sum over the text's tokens of their sha256, a byte a place,
    centred and weighted by the place; zero without tokens. Texts that share words are alike."""
    digests = [hashlib.sha256(t.encode()).digest() for t in _TOKEN.findall(text.lower())]
    if not digests:
        return [0.0] * dimension
    place = np.arange(dimension)
    total = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32).sum(axis=0, dtype=np.int64)
    v = (total[place % 32] / 255.0 - 0.5 * len(digests)) * (1.0 + place % 7 * 0.05)
    return np.round(v / (np.linalg.norm(v) or 1.0), 6).tolist()


def embedder(embed: Callable[[list[str]], list[list[float]]] | None = None, element: str = "float"):
    """A column function of any ``embed(texts)``, called for TEXTS rows of an Arrow batch at a time; what is
    done is kept as Arrow numbers, not as Python's. Null text: null."""
    run = embed or (lambda texts: [hash_embedding(t) for t in texts])

    kind = pa.list_(pa.float64() if element == "double" else pa.float32())

    def embedded(texts: list[str | None]) -> pa.Array:
        known = [t for t in texts if t is not None]
        found = iter(run(known) if known else [])
        return pa.array([None if t is None else next(found) for t in texts], kind)

    @arrow_udf(f"array<{element}>")
    def apply(texts: pa.Array) -> pa.Array:
        parts = [embedded(texts.slice(i, TEXTS).to_pylist()) for i in range(0, len(texts), TEXTS)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return apply


Reranker = Callable[[DataFrame, int], DataFrame]


def rerank_with(reranker: Reranker, hits: DataFrame, k: int) -> DataFrame:
    """A reranker is a function of hits and k that adds rerank_score and new_rank."""
    out = reranker(hits, k)
    missing = {"rerank_score", "new_rank"} - set(out.columns)
    if missing:
        raise ValueError(f"the reranker gives no {sorted(missing)}")
    return out


def register_sql_functions(spark: SparkSession) -> None:
    """For SQL: quarry_embed(text); quarry_findings(text), a table function over one text that is an SQL
    expression, so nothing leaves the JVM; and the table functions over whole tables."""
    from quarry.functions.table_functions import register_table_functions
    from quarry.functions.text import INJECTIONS

    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"

    found = ", ".join(f"transform(regexp_extract_all(coalesce(t, ''), {quoted(p)}, 0), x -> named_struct('code', '{code}', 'severity', '{severity}', 'found', trim(x)))" for code, severity, p in INJECTIONS)
    spark.udf.register("quarry_embed", embedder())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION quarry_findings(t STRING) RETURNS TABLE(code STRING, severity STRING, found STRING) RETURN SELECT inline(concat({found})) AS (code, severity, found)")
    register_table_functions(spark)
