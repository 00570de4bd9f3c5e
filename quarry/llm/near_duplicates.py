"""Near-duplicate documents by BagMinHash.

A document is the multiset of its five-word shingles. Its signature has ``REGISTERS`` registers.
For every shingle a Poisson process runs over the weights 0, 1, 2 ...; the weight axis is cut into
dyadic intervals [0,1), [1,2), [2,4), [4,8) ..., each with a process of its own whose rate is its
length, so a weight w needs about log2(w) of them, and a point of the last interval counts if its
weight lies below w. Each point has a time and a register; a register keeps the earliest. Two
documents agree in a register with a probability of their weighted Jaccard coefficient, exactly,
as the points of both are those of the smaller weight of each shingle. Points are drawn in order
of time, and only up to the time by which the document's registers are full. Intervals are visited
from the lowest up, and a process ends at the first point later than all of the registers that
the document has by then, so a heavy shingle's long intervals cost little. (Within an interval a
point's place is drawn at once, not by halving the interval; its distribution is the same.)

Registers are banded. The members of a band bucket are paired with its hub: the member whose own
buckets hold most texts, which in a group of edited copies is the text they were made from. Each
pair is verified: the multisets' overlap, exactly, at 0.8 or more; components of these links are
joined. Then, in buckets that still hold members of different components, all pairs across
components are verified as well: members are packed in blocks, and a pair is taken in the first band
that it shares. Pairs whose signatures agree in less than ``unlike`` of the registers are left out;
at 0.5 that meets a pair with a coefficient of 0.8 once in 10^13, so in effect a link is lost only if
its documents share no band (at exactly 0.8 five times in 100,000). A group of copies costs about a
pair a member.

Equal texts are one node from the start, whatever their ids. Null and empty texts are equal, and so
are, apart from the texts that equal them, in a class of their own. A class is named by its least
doc_id (a null id stands behind all others). Repeated rows keep a row each. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import mix64, only, released, slices, table, written, written_with
from quarry.llm.components import components
from quarry.llm.shingles import shingle_hashes, weighted

BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
THRESHOLD = 0.8
UNLIKE = 0.5  # agreement of signatures, eight standard deviations below the threshold
BLOCK = 512
BLOCK_BYTES = 1 << 20

_SEEDS = mix64(np.arange(1, 4, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def signatures(hashes: np.ndarray, owner: np.ndarray, weights: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """BagMinHash signatures (n_docs x registers, unsigned 16 bits) of weighted shingles. Rows of
    documents without shingles are zero."""
    total = np.bincount(owner, weights=weights, minlength=n_docs)
    best = np.full(n_docs * registers, np.inf)
    until = np.where(total > 0, registers * (np.log(registers) + 5) / np.maximum(total, 1), -1.0)
    todo = total > 0
    level_of = np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64)  # the last dyadic interval that a weight reaches into
    while todo.any():
        mine = np.flatnonzero(todo[owner])
        for level in range(int(level_of[mine].max()) + 1):
            rows = mine[level_of[mine] >= level]
            length = 1.0 if level == 0 else float(1 << (level - 1))
            low = 0 if level == 0 else 1 << (level - 1)
            seed = mix64(hashes[rows] ^ _SEEDS[0] ^ np.uint64(level * 0x9E3779B1))
            doc, weight = owner[rows], weights[rows]
            limit = np.minimum(until, best.reshape(n_docs, registers).max(axis=1))[doc] if level else until[doc]
            time, k = np.zeros(len(rows)), 0
            while len(rows):
                with np.errstate(over="ignore"):
                    draw = mix64(seed + np.uint64(k + 1) * _SEEDS[1])
                time = time - np.log((np.float64(1) + (draw >> np.uint64(11))) * 2.0**-53) / length
                early = time <= limit
                if not early.all():
                    rows, seed, doc, limit, weight, time, draw = (x[early] for x in (rows, seed, doc, limit, weight, time, draw))
                if not len(rows):
                    break
                place = mix64(draw ^ _SEEDS[2])
                register = (place & np.uint64(0xFFFFFFFF)) % np.uint64(registers)
                if level:
                    y = low + ((place >> np.uint64(32)).astype(np.float64) * 2.0**-32 * length).astype(np.int64)
                    hit = y < weight
                    np.minimum.at(best, doc[hit] * registers + register[hit].astype(np.int64), time[hit])
                else:
                    np.minimum.at(best, doc * registers + register.astype(np.int64), time)
                k += 1
        # a register that nothing reached in time: the document again, for longer
        todo &= np.isinf(best.reshape(n_docs, registers)).any(axis=1)
        until[todo] *= 2
    best[np.isinf(best)] = 0
    return (mix64(best.view(np.uint64)) & np.uint64(0xFFFF)).astype("<u2").reshape(n_docs, registers)


def _node(text: str | None) -> bytes:
    return hashlib.md5((text or "").encode()).digest()


def _node_of(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def sign(docs: DataFrame) -> DataFrame:
    """(node, signature) of every distinct text that has a shingle; a node is the md5 of a text."""

    @released("quarry.llm.shingles")
    def run(batches):
        for batch in slices(batches, "text"):
            texts = batch.column(0)
            hashes, owner, weights = weighted(*shingle_hashes(texts))
            found = signatures(hashes, owner, weights, len(texts))
            has = np.bincount(owner, minlength=len(texts)) > 0
            nodes = [_node(t) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "node": pa.array([n for n, h in zip(nodes, has) if h], pa.binary()),
                    "signature": pa.array([s.tobytes() for s, h in zip(found, has) if h], pa.binary()),
                }
            )

    return docs.select("text").mapInArrow(run, "node binary, signature binary").groupBy("node").agg(F.first("signature").alias("signature"))


def _signature_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, REGISTERS)


def bands(signed: DataFrame) -> DataFrame:
    """(bucket, node), a row a band."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                m = _signature_matrix(part.column(1)).astype(np.uint64).reshape(-1, BANDS, ROWS)
                key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), m.shape[:2])
                with np.errstate(over="ignore"):
                    for r in range(ROWS):
                        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + m[:, :, r])
                key = (key & ~np.uint64(31)) | np.arange(BANDS, dtype=np.uint64)  # the low bits tell the band
                for b in range(BANDS):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(key[:, b]).view(np.int64)), part.column(0)], names=["bucket", "node"])

    return signed.mapInArrow(run, "bucket long, node binary")


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hub_pairs(banded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (bucket, node, n) of buckets of n > 1, and the distinct pairs (a, b) of a
    bucket's hub with its other members."""
    banded = written(banded, "bands")
    sizes = written(banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    members = written(banded.hint("merge").join(sizes, "bucket"), "members")
    fame = written(members.groupBy("node").agg(F.sum("n").alias("fame")), "fame")
    hubs = members.hint("merge").join(fame, "node").groupBy("bucket").agg(F.max_by("node", F.struct("fame", "node")).alias("a"))
    pairs = members.hint("merge").join(written(hubs, "hubs"), "bucket").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    return members, written(pairs, "pairs")


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard coefficient of two (sorted hashes, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return both / (a[1].sum() + b[1].sum() - both)


def _multiset(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    hashes, _, counts = weighted(*shingle_hashes(pa.array([text or ""])))
    return hashes, counts


def _texts_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the given nodes, from one row of each distinct text."""
    texts = docs.select(_node_of("text").alias("node"), "row")
    chosen = texts.groupBy("node").agg(F.min("row").alias("row")).hint("merge").join(nodes, "node")
    return docs.select("row", "text").hint("merge").join(chosen, "row").where(_node_of("text") == F.col("node")).select("node", "text")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) whose multisets overlap enough, by (node, text). The
    pairs of a node are dealt out in chunks, each with one copy of the node's text."""
    spark = pairs.sparkSession
    n = _partitions(spark)

    def chunks(batches):
        hub, left, chunk = None, 0, None
        for batch in batches:
            out = []
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if a != hub or not left:
                    hub, left, chunk = a, BLOCK, hashlib.md5(a + b).digest()
                    out.append((chunk, a, a))
                out.append((chunk, a, b))
                left -= 1
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cols], names=["chunk", "hub", "node"])

    @released("quarry.llm.shingles")
    def check(batches):
        key, mine, before = None, None, None
        for batch in slices(batches, "text"):
            out = []
            for chunk, hub, node, text in zip(*(c.to_pylist() for c in batch.columns)):
                if node == hub:
                    if key != chunk:
                        key, mine, before = chunk, _multiset(text), None
                    continue
                again, before = node == before, node  # a row that is repeated in the input
                if again:
                    continue
                if likeness(mine, _multiset(text)) >= threshold - 1e-12:
                    out.append((hub, node))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], names=["a", "b"])

    dealt = written(pairs.select("a", "b").repartitionByRange(n, "a", "b").sortWithinPartitions("a", "b").mapInArrow(chunks, "chunk binary, hub binary, node binary"), "chunks")
    return (
        dealt.hint("merge")
        .join(texts, "node")
        .select("chunk", "hub", "node", "text")
        .repartition(n, "chunk")
        .sortWithinPartitions("chunk", F.col("node") != F.col("hub"), "node")
        .mapInArrow(check, "a binary, b binary")
    )


def multisets(nodes: DataFrame, signed: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, signature, hashes, counts) of the given nodes: the sorted shingles of a node's text."""

    @released("quarry.llm.shingles")
    def run(batches):
        for batch in slices(batches, "text"):
            sets = [_multiset(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([h.astype("<u8").tobytes() for h, _ in sets], pa.binary()), pa.array([c.astype("<i8").tobytes() for _, c in sets], pa.binary())],
                names=["node", "signature", "hashes", "counts"],
            )

    rows = nodes.hint("merge").join(texts, "node").hint("merge").join(signed, "node").select("node", "signature", "text")
    return rows.dropDuplicates(["node"]).mapInArrow(run, "node binary, signature binary, hashes binary, counts binary")


def links_across(rows: DataFrame, unlike: float = UNLIKE) -> DataFrame:
    """Verified links (a, b) between members of one bucket and different components, from (bucket,
    node, component, signature, hashes, counts). Blocks of members meet each other; of two members
    whose signatures don't rule it out, in the first band they share, the overlap is computed unless
    links found here join their components already."""
    packed_kind = "bucket long, part int, nodes binary, components binary, signatures binary, sizes binary, hashes binary, counts binary"
    names = [k.split()[0] for k in packed_kind.split(", ")]

    def blocks(batches):
        held: list[tuple] = []
        size = part = 0

        def block():
            nonlocal part
            part += 1
            sizes = np.array([len(h[4]) // 8 for h in held], "<i8").tobytes()
            joined = [b"".join(h[i] for h in held) for i in (1, 2, 3, 4, 5)]
            kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 6)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((held[0][0], part, *joined[:3], sizes, *joined[3:]), kinds)], names=names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (held[0][0] != row[0] or len(held) == BLOCK or size > BLOCK_BYTES):
                    yield block()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield block()

    def cross(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                out.extend(_links(r, unlike))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], names=["a", "b"])

    packed = written(
        rows.select("bucket", "node", "component", "signature", "hashes", "counts")
        .repartitionByRange(_partitions(rows.sparkSession), "bucket", "component", "node")
        .sortWithinPartitions("bucket", "component", "node")
        .mapInArrow(blocks, packed_kind)
        .withColumn("id", F.xxhash64("bucket", "part", "nodes")),
        "blocks",
    )
    other = packed.select("bucket", F.col("id").alias("id2"), *(F.col(c).alias(c + "2") for c in names[2:]))
    return packed.hint("merge").join(other, "bucket").where("id <= id2").drop("part", "id", "id2").mapInArrow(cross, "a binary, b binary")


def _links(r: dict, unlike: float) -> list[tuple[bytes, bytes]]:
    """Links between the members of two packed blocks of a bucket."""
    a, b = (np.frombuffer(r[k], "<u2").reshape(-1, REGISTERS) for k in ("signatures", "signatures2"))
    ca, cb, na, nb = (np.frombuffer(r[k], "V16") for k in ("components", "components2", "nodes", "nodes2"))
    (ha, hb), (wa, wb), (sa, sb) = ([np.frombuffer(r[k + x], kind) for x in ("", "2")] for k, kind in (("hashes", "<u8"), ("counts", "<i8"), ("sizes", "<i8")))
    ea, eb = np.cumsum(sa), np.cumsum(sb)
    ta, tb = np.add.reduceat(wa, ea - sa), np.add.reduceat(wb, eb - sb)
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while (up := root.get(x, x)) != x:
            x = up
        return x

    out, band = [], r["bucket"] & 31
    for i in range(len(a)):
        equal = b == a[i]
        # a coefficient is at most the smaller total over the larger
        like = (equal.mean(axis=1) >= unlike) & (cb != ca[i]) & (np.minimum(ta[i], tb) >= (THRESHOLD - 1e-9) * np.maximum(ta[i], tb))
        if not like.any():
            continue
        like &= equal.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
        mine = ca[i].tobytes()
        some = np.array([j for j in np.flatnonzero(like) if find(cb[j].tobytes()) != find(mine)], dtype=np.int64)
        if not len(some):
            continue
        at = np.concatenate([np.arange(eb[j] - sb[j], eb[j]) for j in some])
        own, weight = ha[ea[i] - sa[i] : ea[i]], wa[ea[i] - sa[i] : ea[i]]
        place = np.minimum(np.searchsorted(own, hb[at]), len(own) - 1)
        both = np.where(own[place] == hb[at], np.minimum(weight[place], wb[at]), 0)
        both = np.add.reduceat(both, np.cumsum(sb[some]) - sb[some])
        for j in some[both >= (THRESHOLD - 1e-12) * (ta[i] + tb[some] - both)]:
            x, y = find(mine), find(cb[j].tobytes())
            if x != y:
                root[x] = y
                out.append((na[i].tobytes(), nb[j].tobytes()))
    return out


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id): one row for each row of ``documents`` (doc_id, text)."""
    return _classes(documents).select("doc_id", "class_id")


def one_of_each_class(documents: DataFrame) -> DataFrame:
    """``documents``, all columns, with one document of each class: the one that names it. Where no
    document of a class has an id, one of each of its texts stays."""
    chosen = _classes(documents).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy(F.coalesce("doc_id", F.lit(0)).alias("_id"), "node").agg(F.lit(1).alias("_one"))
    every = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("_row")
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), _node_of("text").alias("node"), every)
    kept = rows.hint("merge").join(written(chosen, "kept"), ["_id", "node"]).dropDuplicates(["_id", "node"])
    return kept.select(*(F.col("_row").getField(c).alias(c) for c in documents.columns))


def _classes(documents: DataFrame) -> DataFrame:
    """(doc_id, node, class_id)"""
    docs = only(documents, doc_id="long", text="string").withColumn("row", F.xxhash64("doc_id", "text"))
    signed = written(sign(docs), "signatures")
    members, pairs = hub_pairs(bands(signed))
    texts = written(_texts_of(members.select("node").distinct(), docs), "texts")  # of candidates, once
    links = written(verified(pairs, texts), "verified")
    labels = components(links)

    members = members.where("n > 2").select("bucket", "node")  # of two, one is the hub
    members = written(members.hint("merge").join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component")), "members")
    mixed = written(members.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket"), "mixed")
    mixed_members = written(members.hint("merge").join(mixed, "bucket"), "mixed-members")
    sets = written(multisets(mixed_members.select("node").distinct(), signed, texts), "multisets")
    more, seen = written_with(links_across(mixed_members.hint("merge").join(sets, "node")), "more", n=F.count(F.lit(1)))
    if seen["n"]:
        labels = components(links.unionByName(more))

    nodes = docs.select("doc_id", _node_of("text").alias("node"))
    least = nodes.groupBy("node").agg(F.min("doc_id").alias("least"))
    named = written(least.hint("merge").join(labels, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component")), "named")
    classes = written(named.groupBy("component").agg(F.min("least").alias("class_id")), "classes")
    by_node = named.hint("merge").join(classes, "component").select("node", "class_id")
    return nodes.hint("merge").join(written(by_node, "by-node"), "node").select("doc_id", "node", "class_id")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
