"""The best documents of some queries, scored where the documents are read.

Queries' terms are few against the corpus: up to MOST_TERMS of them are written to the shared folder
and read by each task, which scores its documents against all queries, a block of both at a time,
and gives each query's best. Neither texts nor postings are shuffled, only those best; nothing is
left out, so no thresholds are needed. More terms than that go through ``impacts``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import GROUP_OF, SYNONYMS
from quarry.session import scratch_path, written

MOST_TERMS = 200_000  # (query, term) rows that a task holds
CELLS, PAIRS, ROWS = 4_000_000, 2_000_000, 2048  # scores, products and documents that it holds at once
SLIP = 2e-4  # scores are rounded to four places
WORD = re.compile(r"[a-z0-9_]{2,}|[0-9]")  # as text.latin_tokens


def shared(rows: DataFrame, name: str) -> str:
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return path


def read_shared(path: str) -> pa.Table:
    store, folder = pafs.FileSystem.from_uri(path)
    files = sorted(f.path for f in store.get_file_info(pafs.FileSelector(folder)) if f.path.endswith(".parquet"))
    parts = []
    for file in files:
        with store.open_input_file(file) as source:
            parts.append(pq.ParquetFile(source).read())
    return pa.concat_tables(parts)


def numbered(path: str) -> dict[str, int]:
    """The terms of a written table and their numbers, which are the same in every task."""
    return {t: i for i, t in enumerate(sorted(set(read_shared(path).column("term").to_pylist()) - {None}))}


def _entries(rows: DataFrame, key: str, parts: Callable, vocabulary: str, extra: str, name: str) -> DataFrame:
    """Written (key, dl, extra, ids, tfs): of each row (key, dl, extra, words) the numbered terms it has."""

    def run(batches):
        terms_of = parts(numbered(vocabulary))
        for batch in batches:
            for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                n, ids, tfs = [], [], []
                for words in part.column(2):
                    size, found = terms_of(words.as_py())
                    n.append(size)
                    ids.append(list(found))
                    tfs.append(list(found.values()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], names=[key, extra, "dl", "ids", "tfs"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return written(rows.mapInArrow(run, f"`{key}` {kinds[key]}, {extra} {kinds[extra]}, dl long, ids array<int>, tfs array<int>"), name)


def word_entries(texts: DataFrame, key: str, vocabulary: str) -> DataFrame:
    """(key, kind, dl, ids, tfs) of texts (key, text): how often each has the terms, dl words in all."""

    def counting(number):
        def of(text):
            words = WORD.findall(text)
            found = Counter(map(number.get, words))
            found.pop(None, None)
            return len(words), found

        return of

    rows = texts.select(key, F.lit(0).alias("kind"), F.lower(F.coalesce("text", F.lit(""))).alias("words"))
    return _entries(rows, key, counting, vocabulary, "kind", "word-entries")


def closed_entries(rows: DataFrame, key: str, vocabulary: str) -> DataFrame:
    """(key, kind, dl, ids, tfs) of rows (key, kind, words array), each closed term (``text.closed_terms``)
    of the words once. A word's terms are found once a task."""

    def closing(number):
        known: dict[str, tuple[int, ...]] = {}

        def terms(word):
            if word in GROUP_OF:
                groups = {GROUP_OF[word]}
            else:
                groups = {g for g, members in enumerate(SYNONYMS) if any(m in word or (len(word) > 1 and word in m) for m in members)}
            mine = [f"#{g}" for g in sorted(groups)] + ([] if word in GROUP_OF else [word])
            return tuple(number[t] for t in mine if t in number)

        def of(words):
            found = {}
            for w in words:
                if (ids := known.get(w)) is None:
                    if len(known) > 1_000_000:
                        known.clear()
                    ids = known[w] = terms(w)
                for i in ids:
                    found[i] = 1
            return len(words), found

        return of

    return _entries(rows.select(key, "kind", "words"), key, closing, vocabulary, "kind", "closed-entries")


def token_entries(rows: DataFrame, key: str, vocabulary: str) -> DataFrame:
    """(key, kind, dl, ids, tfs) of rows (key, kind, words array of distinct tokens): the terms among them."""

    def having(number):
        return lambda words: (len(words), {number[w]: 1 for w in words if w in number})

    return _entries(rows.select(key, "kind", "words"), key, having, vocabulary, "kind", "token-entries")


def _in_order(keys: pa.Array) -> pa.Array:
    """The places of keys in ascending order, null first; a struct's fields one after another."""
    if not pa.types.is_struct(keys.type):
        return pc.array_sort_indices(keys, null_placement="at_start")
    fields = pa.RecordBatch.from_arrays(keys.flatten(), names=[f.name for f in keys.type])
    return pc.sort_indices(fields, sort_keys=[(f.name, "ascending") for f in keys.type], null_placement="at_start")


def best_of_tasks(terms: DataFrame, entries: DataFrame, key: str, k: int, vocabulary: str, impact: Callable, most: float | None = None, bonus: float = 0.0, scopes: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score): each task's best documents of each query, of entries (key, kind, dl, ids, tfs)
    for terms (query_id, term, weight, n, kinds): the sum of weight times ``impact(tf, dl)`` over n, with
    ``bonus`` where the document's kind is one of the query's (bits of kinds), at most ``most``. Of
    documents with one score the k first are given. With ``scopes`` (query_id, scope), and scopes
    array in the entries, they meet only in a scope that both have."""
    path = shared(terms.select("query_id", "term", "weight", "n", "kinds"), "query-weights")
    asked = None if scopes is None else shared(scopes.select("query_id", F.xxhash64("scope").alias("scope")).distinct(), "query-scopes")

    def run(batches):
        number, table = numbered(vocabulary), read_shared(path).combine_chunks()
        queries = pc.unique(table.column("query_id"))
        q = np.asarray(pc.index_in(table.column("query_id"), value_set=queries), np.int64)
        t = np.array([number[x] for x in table.column("term").to_pylist()], np.int64)
        weight = np.asarray(table.column("weight"), np.float64)
        n, kinds = np.ones(len(queries)), np.zeros(len(queries), np.int64)
        n[q], kinds[q] = np.asarray(table.column("n"), np.float64), np.asarray(table.column("kinds"), np.int64)
        inside: dict[int, list[int]] = {}
        if asked is not None:
            owned = read_shared(asked)
            for place, scope in zip(pc.index_in(owned.column("query_id"), value_set=queries).to_pylist(), owned.column("scope").to_pylist()):
                if place is not None:
                    inside.setdefault(scope, []).append(place)
        width = max(1, min(len(queries), CELLS // 256))
        blocks = []
        for a in range(0, len(queries), width):
            mine = np.flatnonzero((q >= a) & (q < a + width))
            mine = mine[np.argsort(t[mine], kind="stable")]
            blocks.append((a, min(width, len(queries) - a), np.searchsorted(t[mine], np.arange(len(number) + 1)), q[mine] - a, weight[mine]))
        bar = np.full(len(queries), -np.inf)
        rows = max(1, min(ROWS, CELLS // width))
        for batch in batches:
            for part in (batch.slice(i, rows) for i in range(0, batch.num_rows, rows)):
                ids, sizes = part.column(3), np.asarray(pc.list_value_length(part.column(3)), np.int64)
                owner, ids = np.repeat(np.arange(part.num_rows), sizes), np.asarray(ids.flatten(), np.int64)
                gain = impact(np.asarray(part.column(4).flatten(), np.float64), np.asarray(part.column(2), np.float64)[owner])
                kind = np.asarray(part.column(1), np.int64)
                first = np.empty(part.num_rows, np.int64)
                first[np.asarray(_in_order(part.column(0)))] = np.arange(part.num_rows)
                meets = None
                if asked is not None:
                    meets = np.zeros((part.num_rows, len(queries)), bool)
                    for d, own in enumerate(part.column(5).to_pylist()):
                        for scope in own:
                            meets[d, inside.get(scope, [])] = True
                for a, wide, start, q_of, w_of in blocks:
                    if not len(q_of):
                        continue
                    score, many = np.zeros(part.num_rows * wide), start[ids + 1] - start[ids]
                    ends = np.cumsum(many)
                    cuts = np.searchsorted(ends, np.arange(PAIRS, (ends[-1] if len(ends) else 0) + PAIRS, PAIRS), side="right")
                    for lo, hi in zip([0, *cuts[:-1]], cuts):
                        if (pairs := many[lo:hi].sum()) == 0:
                            continue
                        at = np.repeat(start[ids[lo:hi]] - (ends[lo:hi] - many[lo:hi] - (ends[lo] - many[lo])), many[lo:hi]) + np.arange(pairs)
                        score += np.bincount(np.repeat(owner[lo:hi], many[lo:hi]) * wide + q_of[at], np.repeat(gain[lo:hi], many[lo:hi]) * w_of[at], part.num_rows * wide)
                    score = score.reshape(part.num_rows, wide)
                    if meets is not None:
                        score[~meets[:, a : a + wide]] = 0
                    met = score > 0
                    score /= n[a : a + wide]
                    if bonus:
                        score += bonus * (met & (kinds[None, a : a + wide] & kind[:, None] > 0))
                    if most is not None:
                        np.minimum(score, most, out=score)
                    if part.num_rows >= k:
                        bar[a : a + wide] = np.maximum(bar[a : a + wide], np.partition(np.where(met, score, -np.inf), part.num_rows - k, axis=0)[part.num_rows - k])
                    d, c = np.nonzero(met & (score >= bar[a : a + wide] - SLIP))
                    s = score[d, c]
                    order = np.lexsort((first[d], -s, c))
                    d, c, s = d[order], c[order], s[order]
                    place = np.arange(len(d))
                    head = np.r_[True, (c[1:] != c[:-1]) | (s[1:] != s[:-1])][: len(d)]
                    kept = place - np.maximum.accumulate(np.where(head, place, 0)) < k
                    d, c, s = d[kept], c[kept], s[kept]
                    yield pa.RecordBatch.from_arrays([queries.take(pa.array(c + a)), part.column(0).take(pa.array(d)), pa.array(s)], names=["query_id", key, "score"])

    kinds_of = {f.name: f.dataType.simpleString() for f in [*terms.schema, *entries.schema]}
    columns = [key, "kind", "dl", "ids", "tfs", *([] if scopes is None else ["scopes"])]
    return entries.select(columns).mapInArrow(run, f"query_id {kinds_of['query_id']}, `{key}` {kinds_of[key]}, score double")
