"""Exact substring de-duplication over the bytes of a corpus, by a sparse suffix array.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document that
comes before, or further left in the same one. Documents are ordered by (doc_id, digest of the
text), a null id last; equal rows are one document, judged once and given back as often as they
occur. Matches never cross documents. Null and empty texts have no bytes.

1. *Anchors.* Of the grams of ``GRAM`` bytes in a window of LENGTH bytes the one with the least
   hash is the window's anchor, so equal windows have equal anchors at equal places. Windows that
   share an anchor are neighbours; the text they span is the anchor's context, and there is one
   anchor in about 37 bytes. Anchors are sorted by range of (gram, document, place), and one whose
   gram's hash occurs nowhere else is done: nothing in its windows is repeated.
2. *Suffixes.* The contexts of the others are cut from the texts. Sampled splitters range-partition
   them by their leading bytes at the anchor. A bucket compares its contexts of equal leading bytes
   byte by byte: all windows of a context that an earlier one equals are repeats. Of the contexts that
   differ it sorts the suffixes at all places by multikey quicksort, eight bytes at a time and only
   among suffixes that are equal so far. Of equal suffixes (in LENGTH bytes) all but the first are
   repeats.
3. *Boundaries.* The first and last group of a bucket may go on in its neighbours. Of those groups
   each bucket hands on the first of every distinct suffix, and these are compared by hash bucket.
4. The repeats meet their texts.

A gram that very many documents share is split by range in steps 1 and 2, and reaches step 3 with
at most one suffix of each kind from each bucket. Hashes only say where to look in steps 1 and 2, and
where buckets meet in step 3, suffixes are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from quarry.llm.common import SLICE_BYTES, byte_view, forget_shuffles, mix64, only, released, run_starts, slices, table, written
from quarry.llm.shingles import _BASE, _INVERSE, _SYMBOLS, _power

LENGTH = 100
GRAM = 28
SPAN = LENGTH - GRAM + 1  # grams in a window
LAST = np.iinfo(np.int64).max  # stands for a null id
CHUNK = 6000

_OTHER = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    least, w = values, 1
    while w * 2 <= width:
        least = np.minimum(least[:-w], least[w:])
        w *= 2
    n = len(values) - width + 1
    return np.minimum(least[:n], least[width - w : width - w + n])


def anchors(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all texts in ``flat``: text number, first and last window start and place of each anchor
    (in flat), and hash of its gram."""
    none = np.zeros(0, np.int64)
    if len(flat) < LENGTH:
        return none, none, none, none, none.astype(np.uint64)
    n = len(flat)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_SYMBOLS[flat] * _power(_INVERSE, n), out=sums[1:])
        power = _power(_BASE, n + 1)
        grams = mix64((sums[GRAM:] - sums[:-GRAM]) * power[GRAM:])
        key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        chosen = (sliding_min(key, SPAN) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        size = np.diff(offsets)
        owner = np.repeat(np.arange(len(size)), np.maximum(size - LENGTH + 1, 0))
        begin = offsets[:-1]
        counts = np.maximum(size - LENGTH + 1, 0)
        start = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner] + begin[owner]
        at = chosen[start]
        new = run_starts(at)
        new[1:] |= owner[1:] != owner[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        p1, p2, a = start[first], start[last], at[first]
        return owner[first], p1, p2, a, grams[a]


def _keys(ids: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    # 64 bits in the digests' order; of a billion rows without an id, two that differ share them with a chance of 3 %
    ties = [int.from_bytes(hashlib.md5((t or "").encode()).digest()[:8], "big") - (1 << 63) for t in texts.to_pylist()]
    return np.asarray(ids.fill_null(LAST), dtype=np.int64), np.array(ties, dtype=np.int64)


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def anchor_rows(docs: DataFrame) -> DataFrame:
    @released("quarry.llm.shingles")
    def run(batches):
        for batch in slices(batches, "text"):
            ids, ties = _keys(batch.column(0), batch.column(1))
            flat, offsets = byte_view(batch.column(1))
            owner, p1, p2, a, gram = anchors(flat, offsets)
            place = (p1 - offsets[owner]) << 16 | (a - p1) << 8 | (p2 - p1)
            for i in range(0, len(owner), 20_000):
                s = slice(i, i + 20_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((gram[s] >> np.uint64(16)).astype(np.int64)), pa.array(ids[owner[s]]), pa.array(ties[owner[s]]), pa.array(place[s])],
                    names=["gram", "doc", "tie", "place"],
                )

    return docs.mapInArrow(run, "gram long, doc long, tie long, place long")


def _gathered(batches) -> list[np.ndarray]:
    parts = [[np.asarray(c) for c in b.columns] for b in batches if b.num_rows]
    return [np.concatenate(c) for c in zip(*parts)] if parts else []


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """(doc, tie, place) of the anchors whose gram occurs elsewhere too. Grams at the edges of a
    partition may go on in others and stay."""

    @released("quarry.llm.shingles")
    def run(batches):
        columns = _gathered(batches)
        if not columns:
            return
        gram, doc, tie, place = columns
        group = run_starts(gram)
        again = np.zeros(len(gram), dtype=bool)  # equal rows of the input
        again[1:] = ~group[1:] & (doc[1:] == doc[:-1]) & (tie[1:] == tie[:-1]) & (place[1:] == place[:-1])
        number = np.cumsum(group) - 1
        several = np.bincount(number, weights=~again) > 1
        several[[0, -1]] = True
        keep = several[number] & ~again
        doc, tie, place = doc[keep], tie[keep], place[keep]
        for i in range(0, len(doc), 20_000):
            s = slice(i, i + 20_000)
            yield pa.RecordBatch.from_arrays([pa.array(doc[s]), pa.array(tie[s]), pa.array(place[s])], names=["doc", "tie", "place"])

    order = ["gram", "doc", "tie", "place"]
    return rows.repartitionByRange(_partitions(rows.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(run, "doc long, tie long, place long")


def _schema(columns: str, carry: DataType) -> StructType:
    return StructType([*StructType.fromDDL(columns).fields, StructField("carry", carry)])


def _with_texts(docs: DataFrame, rows: DataFrame, run, schema: str) -> DataFrame:
    """Bring ``rows`` (doc, tie, a, b) to their documents' texts: ``run`` sees of each document its
    rows of texts (compressed) and then the others. One document's rows are bounded by its length.
    ``docs`` is (doc_id, text, carry); what carry holds, of any type, goes along with the text."""
    kind = docs.schema["carry"].dataType

    @released("quarry.llm.shingles")
    def pack(batches):
        codec = pa.Codec("zstd", compression_level=1)
        for batch in slices(batches, "text"):
            ids, ties = _keys(batch.column(0), batch.column(1))
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(ties), pa.array([len(r) for r in raw], pa.int64()), pa.array([codec.compress(r, asbytes=True) if r else b"" for r in raw], pa.binary()), batch.column(2)],
                names=["doc", "tie", "a", "text", "carry"],
            )

    packed = docs.mapInArrow(pack, _schema("doc long, tie long, a long, text binary", kind)).select("doc", "tie", "a", F.lit(0).cast("long").alias("b"), "text", "carry")
    nothing = (F.lit(None).cast("binary").alias("text"), F.lit(None).cast(kind).alias("carry"))
    return (
        packed.unionByName(rows.select("doc", "tie", "a", "b", *nothing))
        .repartition(_partitions(docs.sparkSession), "doc", "tie")
        .sortWithinPartitions("doc", "tie", F.col("text").isNull())
        .mapInArrow(run, schema)
    )


def _documents(batches):
    """(doc, tie, [(text, carry)], a, b) of each document in batches as ``_with_texts`` makes them."""
    codec = pa.Codec("zstd")
    key, texts, left, right = None, [], [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, tie, a, b = (np.asarray(batch.column(i)) for i in range(4))
        is_text = np.asarray(batch.column(4).is_valid())
        new = run_starts(doc) | run_starts(tie)
        cuts = np.flatnonzero(new)
        for i, j in zip(cuts, [*cuts[1:], len(doc)]):
            if (doc[i], tie[i]) != key:
                if key is not None:
                    yield *key, texts, np.concatenate(left), np.concatenate(right)
                key, texts, left, right = (doc[i], tie[i]), [], [], []
            k = i + int(is_text[i:j].sum())
            for r in range(i, k):
                raw = batch.column(4)[r].as_py()
                texts.append((codec.decompress(raw, int(a[r]), asbytes=True) if a[r] else b"", batch.column(5)[r].as_py()))
            left.append(a[k:j])
            right.append(b[k:j])
    if key is not None:
        yield *key, texts, np.concatenate(left), np.concatenate(right)


def contexts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(lead, doc, tie, start, context) of the anchors (doc, tie, place)."""

    @released("quarry.llm.shingles")
    def run(batches):
        out = []

        def flush():
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["lead", "doc", "tie", "start", "context"])
            out.clear()
            return batch

        for doc, tie, texts, places, _ in _documents(batches):
            text = texts[0][0]
            for place in sorted(set(places.tolist())):
                p1, skip, more = place >> 16, place >> 8 & 255, place & 255
                out.append((text[p1 + skip : p1 + skip + GRAM], doc, tie, p1, text[p1 : p1 + more + LENGTH]))
            if len(out) >= 5000:
                yield flush()
        if out:
            yield flush()

    return _with_texts(docs, chosen.select("doc", "tie", F.col("place").alias("a"), F.lit(0).cast("long").alias("b")), run, "lead binary, doc long, tie long, start long, context binary")


def suffix_order(flat: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the strings of ``length`` bytes at ``starts``: their order, and where
    in it a new string begins. Each round sorts by the next eight bytes what is equal so far."""
    views = np.lib.stride_tricks.sliding_window_view(flat, 8)

    def word(which: np.ndarray, at: int) -> np.ndarray:
        return np.ascontiguousarray(views[starts[which] + at]).view(">u8").ravel().astype(np.uint64)

    order = np.arange(len(starts))
    keys = word(order, 0)
    order = np.argsort(keys, kind="stable")
    new = run_starts(keys[order])
    for at in [*range(8, length - 8, 8), length - 8]:
        group = np.cumsum(new) - 1
        open_ = np.flatnonzero((np.bincount(group) > 1)[group])
        if not len(open_):
            break
        mine, group = order[open_], group[open_]
        keys = word(mine, at)
        if not ((keys[1:] != keys[:-1]) & (group[1:] == group[:-1])).any():
            continue  # nothing is told apart by these bytes
        by = np.lexsort((keys, group))
        order[open_] = mine[by]
        keys, group = keys[by], group[by]
        new[open_[1:]] |= (keys[1:] != keys[:-1]) & (group[1:] == group[:-1])
    return order, new


def compare_suffixes(rows: DataFrame, n: int) -> DataFrame:
    """(doc, tie, a, b): repeated stretches; and, with a bucket, packed suffixes of groups at the
    edge of a partition for ``compare_boundaries``. Contexts come in order, so the first of equal ones
    is kept and each later one is a repeat as a whole."""

    def chunk(part: list[tuple], edge_leads: set) -> tuple[list, list]:
        flat = np.frombuffer(b"".join(r[4] for r in part), np.uint8)
        size = np.array([len(r[4]) for r in part])
        begin = np.cumsum(size) - size
        count = size - LENGTH + 1
        owner = np.repeat(np.arange(len(part)), count)
        inner = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
        starts = begin[owner] + inner
        doc, tie, start = (np.array([r[i] for r in part], dtype=np.int64) for i in (1, 2, 3))
        order, new = suffix_order(flat, starts, LENGTH)
        group = np.cumsum(new) - 1
        o = owner[order]
        by = np.lexsort((start[o] + inner[order], tie[o], doc[o], group))
        order, o = order[by], o[by]
        new = run_starts(group[by])
        position = start[o] + inner[order]
        lead = np.flatnonzero(new)
        first_of = np.repeat(lead, np.diff(np.append(lead, len(order))))
        # (equal rows of the input hold the same place twice)
        same = (doc[o] == doc[o][first_of]) & (tie[o] == tie[o][first_of]) & (position == position[first_of])
        repeated = np.zeros(len(order), dtype=bool)
        repeated[order] = ~same
        # neighbouring repeats of a context are one stretch
        begins = repeated.copy()
        begins[1:] &= ~(repeated[:-1] & (owner[1:] == owner[:-1]))
        ends = repeated.copy()
        ends[:-1] &= ~(repeated[1:] & (owner[1:] == owner[:-1]))
        i, j = np.flatnonzero(begins), np.flatnonzero(ends)
        marks = [doc[owner[i]], tie[owner[i]], start[owner[i]] + inner[i], start[owner[j]] + inner[j] + LENGTH]
        at_edge = np.array([r[0] in edge_leads for r in part])
        go = order[new & at_edge[o]]
        if not len(go):
            return marks, []
        views = np.lib.stride_tricks.sliding_window_view(flat, 8)
        h1, h2 = np.zeros(len(go), np.uint64), np.zeros(len(go), np.uint64)
        with np.errstate(over="ignore"):
            for k, at in enumerate([*range(0, LENGTH - 8, 8), LENGTH - 8]):
                w = np.ascontiguousarray(views[starts[go] + at]).view(">u8").ravel().astype(np.uint64)
                h1, h2 = mix64(h1 * _BASE + w * _OTHER[k]), mix64(h2 * _INVERSE + w * _OTHER[k + 20])
        g = owner[go]
        packed = np.stack([h1.view(np.int64), h2.view(np.int64), doc[g], tie[g], start[g] + inner[go]], axis=1)
        return marks, [packed]

    @released("quarry.llm.shingles")
    def run(batches):
        held: list[tuple] = []
        handed: list[np.ndarray] = []
        first_lead = lead = None
        seen: dict[bytes, tuple] = {}  # the contexts of the lead that is read

        def marks(found):
            m, h = found
            handed.extend(h)
            for i in range(0, len(m[0]), 20_000):
                k = len(m[0][i : i + 20_000])
                yield pa.RecordBatch.from_arrays([*(pa.array(c[i : i + 20_000]) for c in m), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=["doc", "tie", "a", "b", "bucket", "packed"])

        for batch in batches:
            again = ([], [], [], [])
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != lead:
                    if lead is None:
                        first_lead = row[0]
                    # groups stay whole, in a chunk of at most CHUNK contexts and one group
                    if len(held) >= CHUNK:
                        yield from marks(chunk(held, {first_lead}))
                        held = []
                    lead = row[0]
                    seen.clear()
                first = seen.setdefault(row[4], row)
                if first is row:
                    held.append(row)
                elif first[1:4] != row[1:4]:
                    for column, value in zip(again, (row[1], row[2], row[3], row[3] + len(row[4]))):
                        column.append(value)
            if again[0]:
                yield from marks(([np.array(c, dtype=np.int64) for c in again], []))
        if held:
            yield from marks(chunk(held, {first_lead, held[-1][0]}))
        if handed:
            rows_ = np.concatenate(handed)
            bucket = (rows_[:, 0].view(np.uint64) % np.uint64(n)).astype(np.int64)
            rows_ = rows_[np.argsort(bucket, kind="stable")]
            bounds = np.searchsorted(np.sort(bucket), np.arange(n + 1))
            for b in range(n):
                part = rows_[bounds[b] : bounds[b + 1]]
                if len(part):
                    empty = pa.nulls(1, pa.int64())
                    yield pa.RecordBatch.from_arrays([empty, empty, empty, empty, pa.array([b], pa.int32()), pa.array([part.astype("<i8").tobytes()], pa.binary())], names=["doc", "tie", "a", "b", "bucket", "packed"])

    order = ["lead", "doc", "tie", "start"]
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, "doc long, tie long, a long, b long, bucket int, packed binary")


def compare_boundaries(rows: DataFrame, n: int) -> DataFrame:
    """(doc, tie, a, b) from (bucket, packed): of equal suffixes all but the first."""

    @released("quarry.llm.shingles")
    def run(batches):
        parts = [np.frombuffer(p, "<i8").reshape(-1, 5) for b in batches for p in b.column(1).to_pylist()]
        if not parts:
            return
        rows_ = np.concatenate(parts)
        rows_ = rows_[np.lexsort(rows_.T[::-1])]
        new = run_starts(rows_[:, 0]) | run_starts(rows_[:, 1])
        lead = np.flatnonzero(new)
        first = rows_[np.repeat(lead, np.diff(np.append(lead, len(rows_))))]
        later = rows_[(rows_[:, 2:] != first[:, 2:]).any(axis=1)]
        for i in range(0, len(later), 20_000):
            s = later[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(s[:, 2]), pa.array(s[:, 3]), pa.array(s[:, 4]), pa.array(s[:, 4] + LENGTH)], names=["doc", "tie", "a", "b"])

    return rows.select("bucket", "packed").repartition(n, "bucket").mapInArrow(run, "doc long, tie long, a long, b long")


def repeated_stretches(docs: DataFrame) -> DataFrame:
    """(doc, tie, a, b): byte ranges whose every string of LENGTH bytes starts earlier as well."""
    n = _partitions(docs.sparkSession)
    chosen = written(repeated_anchors(anchor_rows(docs.select("doc_id", "text"))), "anchors")
    forget_shuffles(docs.sparkSession)
    suffixes = written(compare_suffixes(contexts(docs, chosen), n), "suffixes")
    forget_shuffles(docs.sparkSession)
    inner = suffixes.where("bucket is null").select("doc", "tie", "a", "b")
    return inner.unionByName(compare_boundaries(suffixes.where("bucket is not null"), n))


def _judged(docs: DataFrame, keep_text: bool) -> DataFrame:
    @released("quarry.llm.shingles")
    def run(batches):
        out, size, carried = [], 0, None

        def noted():
            nonlocal carried
            for batch in batches:
                carried = batch.column(5).type
                yield batch

        def flush():
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), carried)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "carry"])
            out.clear()
            return batch

        for doc, _, texts, a, b in _documents(noted()):
            text = np.frombuffer(texts[0][0], np.uint8)
            if len(a):
                depth = np.zeros(len(text) + 1, np.int64)
                np.add.at(depth, a, 1)
                np.add.at(depth, b, -1)
                gone = np.cumsum(depth)[:-1] > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept, removed = text[~gone].tobytes(), int(gone.sum())
            else:
                kept, removed, spans = texts[0][0], 0, 0
            found = (None if doc == LAST else int(doc), len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if keep_text else None)
            out.extend((*found, carry) for _, carry in texts)
            size += len(kept) * keep_text * len(texts)
            if len(out) >= 500 or size > SLICE_BYTES:
                yield flush()
                size = 0
        if out:
            yield flush()

    return _with_texts(docs, repeated_stretches(docs), run, _schema("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string", docs.schema["carry"].dataType))


def repeats(documents: DataFrame) -> DataFrame:
    """One row for each row of ``documents`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans and
    kept_sha256, the digest of the bytes that stay."""
    docs = only(documents, doc_id="long", text="string").withColumn("carry", F.lit(None).cast("string"))
    return _judged(docs, False).drop("text", "carry")


def without_repeats(documents: DataFrame) -> DataFrame:
    """``documents`` with the repeated bytes taken out of ``text`` (a character that is cut is
    dropped) and all other columns as they are, but for ``n_chars`` where there is one. A null text stays
    null, and so does what its row says of it. A document of which nothing but white space is left goes, unless nothing was taken from it."""
    others = [c for c in documents.columns if c not in ("doc_id", "text")]
    rest = [F.struct(*(F.col(f"`{c}`") for c in others)).alias("rest")] if others else []
    carry = F.struct(F.col("text").isNull().alias("no_text"), *rest)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), carry.alias("carry"))
    found = _judged(docs, True).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    no_text = F.col("carry.no_text")
    own = lambda c: F.col("carry.rest").getField(c)
    cols = {"doc_id": lambda: F.col("doc_id"), "text": lambda: F.when(~no_text, F.col("text")), "n_chars": lambda: F.when(no_text, own("n_chars").cast("long")).otherwise(F.length("text").cast("long"))}
    return found.select(*(cols.get(c, lambda c=c: own(c))().alias(c) for c in documents.columns))


def op1_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
