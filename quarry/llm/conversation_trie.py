"""Prefix trie of conversations, by burst tries.

A turn's id is a digest of its role and text with the text's length behind it, so no text is shuffled.
A conversation's ids are cut in blocks of BLOCK turns (the last has fewer, perhaps none), and the
prefix before a block is the trie head that the block hangs under, as a suffix in the head's
container: a conversation of any length is many rows. Equal suffixes of a container are one row with
counts. A container with more than CAPACITY different suffixes bursts: the prefix that all of them
share becomes trie nodes, and each next turn id a container of its own, until none is oversized (at
most BLOCK rounds, for all heads at once). The containers that remain are dealt out by head, sorted,
and swept: neighbours share nodes as far as their ids agree.

Sums over subtrees are sums over members. A node belongs to its smallest member, and the nodes that
belong to one conversation are the lower part of its path. So with V(c) the savings of all nodes of
c, a node's subtree saves the sum of V over its members, less those of its owner's nodes above it;
and it has as many leaves as its members own. V and the leaves are weights of the conversations,
and a second walk over the trie sums them up.

Keys of heads are 128 bits of hashes of the blocks before them, ids 128 bits of sha256: two prefixes
or turns would have to agree in all of them to be taken for one.

Turns are ordered by (turn, id), nulls first. A null role or text is empty. Rows without a conv_id
belong to no conversation. Repeated rows are repeated turns. Other columns are ignored. Without
conversations there is no node. A container's suffixes stand whole in a task: CAPACITY blocks.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import only, released, table, written
from quarry.llm.ranges import before

BLOCK = 64
CAPACITY = 4096
DIGEST, UNIT = 16, 20  # bytes of an id: a digest and a length
PIECE = 1 << 14  # bytes of conv_ids in one row
BROADCAST_ROWS = 200_000  # of heads, a few dozen bytes each
HEAD = ["h1", "h2"]
SUMS = ["n", "leaves", "saved"]
NODE = "link boolean, k1 long, k2 long, e1 long, e2 long, depth long, conv long, up long, n long, children long, leaves long, saved long, size long"


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, turn, id, position from 0)"""
    rows = only(conversations, conv_id="long", turn="long", role="string", text="string").where("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, DIGEST)
    rows = rows.select(F.col("conv_id").alias("conv"), "turn", F.concat(digest, F.unhex(F.lpad(F.hex(F.octet_length(text)), 2 * (UNIT - DIGEST), "0"))).alias("id"), F.lit(1).alias("one"))
    return before(written(rows, "turn-ids"), "conv", ["turn", "id"], "turns", {"one": "position"}).drop("one", "turn")


def rebuilt(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are another's: those of conversation c - c % ``every`` up to
    crc32(c) % ``most``, then c's own behind as many. Gives (conv, position, id) and (conv, n)."""
    convs = turns.groupBy("conv").agg(F.count("*").alias("own"))
    convs = written(convs.withColumns({"h": F.crc32(F.col("conv").cast("string")) % most, "base": F.col("conv") - F.col("conv") % every}), "conversations")
    lengths = convs.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    convs = written(convs.hint("merge").join(lengths, "base", "left").withColumn("head", F.least("h", F.coalesce("base_own", F.lit(0)))).drop("base_own"), "heads")
    firsts = turns.where((F.col("position") < most - 1) & (F.col("conv") % every == 0)).select(F.col("conv").alias("base"), "position", "id")
    given = convs.where("h > 0").select("conv", "base", "h").hint("merge").join(firsts, "base").where("position < h")
    own = turns.hint("merge").join(convs.select("conv", "h", "head"), "conv").where("position >= h").withColumn("position", F.col("head") + F.col("position") - F.col("h"))
    rows = given.select("conv", "position", "id").unionByName(own.select("conv", "position", "id"))
    return written(rows, "rebuilt"), convs.select("conv", (F.col("head") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("n"))


def suffixes(turns: DataFrame, lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, block, ids, h1, h2, e1, e2, ends): the blocks of each conversation, with the keys of the
    prefixes before and with it; the one that ``ends`` a conversation has fewer than ``block`` ids."""
    cells = F.sort_array(F.collect_list(F.struct("position", "id")))
    ids = F.aggregate(cells, F.lit(b""), lambda whole, cell: F.concat(whole, cell["id"]))
    full = turns.groupBy("conv", F.floor(F.col("position") / block).alias("block")).agg(ids.alias("ids"))
    rest = lengths.where(F.col("n") % block == 0).select("conv", F.floor(F.col("n") / block).alias("block"), F.lit(b"").alias("ids"))
    rows = full.unionByName(rest).withColumn("ends", F.octet_length("ids") < block * UNIT)
    rows = written(rows.withColumns({f"k{i}": F.xxhash64(F.lit(i), "block", "ids") for i in (1, 2)}), "blocks")
    alone = (F.col("block") == 0) & F.col("ends")
    chained = before(rows.where(~alone), "conv", ["block"], "chains", {"k1": "h1", "k2": "h2"}, F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    rows = rows.where(alone).withColumns({"h1": F.lit(0).cast("long"), "h2": F.lit(0).cast("long")}).unionByName(chained)
    return written(rows.withColumns({f"e{i}": F.col(f"h{i}").bitwiseXOR(F.col(f"k{i}")) for i in (1, 2)}).drop("k1", "k2"), "suffixes")


def _size_of(unit: Column) -> Column:
    return F.conv(F.hex(F.substring(unit, DIGEST + 1, UNIT - DIGEST)), 16, 10).cast("long")


def _met(rows: DataFrame, heads: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """Rows with what their heads have; a hot head's rows stay where they are, or a sort-merge join of
    written tables splits them."""
    return rows.join(F.broadcast(heads), HEAD, how) if n <= BROADCAST_ROWS else rows.hint("merge").join(heads, HEAD, how)


def burst(rows: DataFrame, heads: DataFrame, n: int, block: int) -> tuple[DataFrame, DataFrame]:
    """What the suffixes ``rows`` become under ``heads`` (h1, h2), which all of them have, and the
    nodes of the prefix that a head's suffixes share."""
    shared = F.when(F.octet_length("low") < UNIT, 0).otherwise(
        F.size(F.filter(F.sequence(F.lit(1), F.floor(F.octet_length("low") / UNIT).cast("int")), lambda i: F.substring("low", F.lit(1), i * UNIT) == F.substring("high", F.lit(1), i * UNIT)))
    )
    found = rows.groupBy(*HEAD, "depth").agg(
        F.min("ids").alias("low"), F.max("ids").alias("high"), F.min("up").alias("up"), F.min("size").alias("size"), F.min("conv").alias("least"), *(F.sum(c).alias(f"all_{c}") for c in SUMS)
    )
    found = written(found.withColumn("shared", shared).drop("high"), "bursting")
    inside = _met(rows.drop("up", "size", "depth"), found.select(*HEAD, "depth", "shared", "least"), n)
    at = F.col("shared") * UNIT
    nearer = inside.where(F.octet_length("ids") > at).select(
        "*", *(F.xxhash64(F.lit(10 + i), *HEAD, F.substring("ids", F.lit(1), at + UNIT)).alias(f"c{i}") for i in (1, 2)), F.substring("ids", at + 1, F.lit(UNIT)).alias("next")
    )
    nearer = written(nearer.withColumn("out", ~F.col("ends") & (F.octet_length("ids") == at + UNIT)), "burst")
    moved = nearer.where("not out").select(
        F.col("c1").alias("h1"), F.col("c2").alias("h2"), (F.col("depth") + F.col("shared") + 1).alias("depth"), F.col("least").alias("up"), _size_of(F.col("next")).alias("size"),
        F.substring("ids", at + UNIT + 1, F.lit(block * UNIT)).alias("ids"), "conv", *SUMS, "e1", "e2", "ends",
    )
    none = F.lit(None).cast("long")
    links = nearer.where("out").select(
        F.lit(True).alias("link"), F.col("e1").alias("k1"), F.col("e2").alias("k2"), none.alias("e1"), none.alias("e2"), (F.col("depth") + F.col("shared") + 1).alias("depth"), "conv",
        F.col("least").alias("up"), "n", F.lit(0).cast("long").alias("children"), "leaves", "saved", _size_of(F.col("next")).alias("size"),
    )
    children = written(nearer.select(*HEAD, "c1", "c2").distinct().groupBy(*HEAD).agg(F.count("*").alias("children")), "children")
    over = written(inside.where(F.octet_length("ids") == at).select(*HEAD, "e1", "e2"), "exhausted")  # a row a head: it ends, the others being longer
    chain = found.hint("merge").join(children, HEAD).hint("merge").join(over, HEAD, "left").withColumn("i", F.explode(F.sequence(F.lit(0), "shared")))
    top, last = F.col("i") == 0, F.col("i") == F.col("shared")
    root = top & F.col("up").isNull()
    nodes = chain.select(
        F.lit(False).alias("link"), *(F.when(root & (F.col("depth") > 0), F.col(h)).alias(k) for h, k in zip(HEAD, ("k1", "k2"))), *(F.when(last, F.col(e)).alias(e) for e in ("e1", "e2")),
        (F.col("depth") + F.col("i")).alias("depth"), F.col("least").alias("conv"), F.when(top, F.col("up")).otherwise(F.col("least")).alias("up"), F.col("all_n").alias("n"),
        F.when(last, F.col("children")).otherwise(1).cast("long").alias("children"), F.col("all_leaves").alias("leaves"), F.col("all_saved").alias("saved"),
        F.when(top, F.col("size")).otherwise(_size_of(F.substring("low", (F.col("i") - 1) * UNIT + 1, F.lit(UNIT)))).alias("size"),
    )
    return written(moved, "containers"), nodes.unionByName(links)


class _Container:
    """The sorted suffixes of one head, swept into nodes as they come."""

    def __init__(self, head: tuple, depth: int, up: int | None, size: int | None):
        self.head, self.depth, self.up = head, depth, up
        self.before, self.path = b"", [0]  # the last suffix, and the records on its path
        self.parent, self.level, self.sizes, self.link, self.end = [0], [depth], [size], [False], [None]
        self.conv, self.sums, self.children = [None], [[0, 0, 0]], [0]

    def add(self, ids: bytes, conv: int, sums: list[int], end: tuple, ends: bool) -> None:
        shared, most, last = 0, min(len(ids), len(self.before)), self.before
        while shared < most and ids[shared : shared + UNIT] == last[shared : shared + UNIT]:
            shared += UNIT
        self.before, path = ids, self.path
        del path[shared // UNIT + 1 :]
        for a in range(shared, len(ids), UNIT):
            self.parent.append(path[-1])
            self.level.append(self.depth + a // UNIT + 1)
            self.sizes.append(int.from_bytes(ids[a + DIGEST : a + UNIT], "big"))
            self.link.append(False)
            self.end.append(None)
            self.conv.append(None)
            self.sums.append([0, 0, 0])
            self.children.append(0)
            self.children[path[-1]] += 1
            path.append(len(self.parent) - 1)
        at = path[-1]
        self.end[at], self.link[at] = end, not ends  # a suffix that goes on leads to the head of another container
        self.conv[at] = conv if self.conv[at] is None else min(conv, self.conv[at])
        self.sums[at] = [a + b for a, b in zip(self.sums[at], sums)]

    def records(self):
        for i in range(len(self.parent) - 1, 0, -1):
            p = self.parent[i]
            self.conv[p] = self.conv[i] if self.conv[p] is None else min(self.conv[p], self.conv[i])
            self.sums[p] = [a + b for a, b in zip(self.sums[p], self.sums[i])]
        for i, link in enumerate(self.link):
            key = self.end[i] if link else self.head if not i and self.up is None and self.depth else (None, None)
            end = (self.end[i] or (None, None)) if not link else (None, None)
            up = self.conv[self.parent[i]] if i else self.up
            yield (link, *key, *end, self.level[i], self.conv[i], up, self.sums[i][0], self.children[i], *self.sums[i][1:], self.sizes[i])


def _batch(records: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in NODE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if i == 0 else pa.int64()) for i, c in enumerate(zip(*records))], names=names)


def swept(containers: DataFrame) -> DataFrame:
    """NODE rows of containers that are small enough: one head's suffixes in order."""

    @released()
    def sweep(batches):
        now, out = None, []
        for batch in batches:
            for h1, h2, ids, depth, up, size, conv, e1, e2, ends, *sums in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.head != (h1, h2):
                    if now:
                        out.extend(now.records())
                    now = _Container((h1, h2), depth, up, size)
                    while len(out) >= 10_000:
                        yield _batch(out[:10_000])
                        del out[:10_000]
                now.add(ids, conv, sums, (e1, e2), ends)
        if now:
            out.extend(now.records())
        for a in range(0, len(out), 10_000):
            yield _batch(out[a : a + 10_000])

    n = int(containers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = containers.select(*HEAD, "ids", "depth", "up", "size", "conv", "e1", "e2", "ends", *SUMS)
    return rows.repartition(n, *HEAD).sortWithinPartitions(*HEAD, "ids").mapInArrow(sweep, NODE)


def trie(blocks: DataFrame, block: int = BLOCK, capacity: int = CAPACITY) -> DataFrame:
    """The nodes over suffixes (conv, block, ids, h1, h2, e1, e2, ends, n, leaves, saved): depth, conv,
    up (the parent's smallest member; of the root null), n, children, leaves and saved summed over the
    members, size of the last text, and e1, e2, the key of conversations that end there (or null)."""
    sums = [F.sum(c).cast("long").alias(c) for c in SUMS]
    rows = blocks.groupBy(*HEAD, "block", "ids", "e1", "e2", "ends").agg(F.min("conv").alias("conv"), *sums)
    rows = rows.withColumns({"depth": F.col("block") * block, "up": F.lit(None).cast("long"), "size": F.when(F.col("block") == 0, 0).cast("long")}).drop("block")
    rows, calm, nodes = written(rows, "containers"), [], []
    while True:
        big = written(rows.groupBy(*HEAD).agg(F.count("*").alias("rows")).where(F.col("rows") > capacity), "oversized")
        n = big.count()
        if not n:
            break
        marked = written(_met(rows, big, n, "left"), "marked")
        calm.append(marked.where("rows is null").drop("rows"))
        rows, made = burst(marked.where("rows is not null").drop("rows"), big, n, block)
        nodes.append(made)
    nodes.append(swept(reduce(DataFrame.unionByName, calm, rows)))
    found = written(reduce(DataFrame.unionByName, nodes), "trie-nodes")
    # the first node of a block below the first: its last turn stands in another container
    beneath = found.where("not link and up is null and depth > 0").drop("up", "size")
    links = found.where("link").select("k1", "k2", "up", "size")
    whole = found.where("not link and (up is not null or depth = 0)")
    return whole.unionByName(beneath.hint("merge").join(links, ["k1", "k2"])).drop("link", "k1", "k2")


def ends_digests(ends: DataFrame) -> DataFrame:
    """(e1, e2, ends_sha256) of (e1, e2, conv): sha256 of each key's conv_ids in ascending order, with
    commas. Ids of a key may lie in many range partitions; each makes pieces of PIECE bytes, and
    what hashes a key's pieces in turn holds one of them."""

    @released()
    def pack(batches):
        part = pa.scalar(0)
        key, piece, held, seq, out = None, [], 0, 0, []
        flush = lambda: out.append((*key, part, seq, ",".join(piece).encode()))
        for batch in batches:
            for e1, e2, conv, part in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (e1, e2) or held >= PIECE:
                    if key is not None:
                        flush()
                    key, piece, held, seq = (e1, e2), [], 0, seq + 1
                piece.append(str(conv))
                held += len(piece[-1]) + 1
                if len(out) >= 1000:
                    yield rows_of(out)
                    out.clear()
        if key is not None:
            flush()
            yield rows_of(out)

    def rows_of(out):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["e1", "e2", "part", "seq", "piece"])

    @released()
    def digest(batches):
        key, sha, out = None, None, []
        for batch in batches:
            for e1, e2, piece in zip(*(batch.column(c).to_pylist() for c in ("e1", "e2", "piece"))):
                if key != (e1, e2):
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (e1, e2), hashlib.sha256(piece)
                else:
                    sha.update(b"," + piece)
            if out:
                yield digests_of(out)
                out.clear()
        if key is not None:
            yield digests_of([(*key, sha.hexdigest())])

    def digests_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], names=["e1", "e2", "ends_sha256"])

    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["e1", "e2", "conv"]
    pieces = ends.select(*order).repartitionByRange(n, *order).withColumn("part", F.spark_partition_id().cast("long")).sortWithinPartitions(*order).mapInArrow(pack, "e1 long, e2 long, part long, seq long, piece binary")
    return pieces.repartition(n, "e1", "e2").sortWithinPartitions("e1", "e2", "part", "seq").mapInArrow(digest, "e1 long, e2 long, ends_sha256 string")


def nodes(turns: DataFrame, lengths: DataFrame, block: int = BLOCK, capacity: int = CAPACITY) -> DataFrame:
    """A row a node of the trie of turns (conv, position, id) and lengths (conv, n): conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    blocks = suffixes(turns, lengths, block)
    zero = F.lit(0).cast("long")
    first = written(trie(blocks.withColumns({"n": F.lit(1).cast("long"), "leaves": zero, "saved": zero}), block, capacity).drop("leaves", "saved"), "nodes")
    saving = (F.col("n") - 1) * F.col("size")
    weights = first.groupBy("conv").agg(F.sum(saving).cast("long").alias("saved"), F.count_if(F.col("children") == 0).alias("leaves"))
    weighed = blocks.hint("merge").join(written(weights, "weights"), "conv", "left").withColumns({"n": zero, "leaves": F.coalesce("leaves", zero), "saved": F.coalesce("saved", zero)})
    summed = trie(written(weighed, "weighed"), block, capacity).select("conv", "depth", "leaves", "saved")
    above = before(first.where("n > 1").select("conv", "depth", saving.cast("long").alias("saving")), "conv", ["depth"], "savings", {"saving": "above"}).drop("saving")
    rows = first.hint("merge").join(written(summed, "sums"), ["conv", "depth"]).hint("merge").join(written(above, "above"), ["conv", "depth"], "left")
    rows = written(rows, "summed-nodes")
    digests = written(ends_digests(blocks.where("ends")), "ends")
    empty = rows.where("e1 is null").withColumn("ends_sha256", F.sha2(F.lit(b""), 256))
    ended = rows.where("e1 is not null").hint("merge").join(digests, ["e1", "e2"])
    return empty.unionByName(ended.select(empty.columns)).select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("up").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.when(F.col("n") > 1, F.col("saved") - F.col("above")).otherwise(0).cast("long").alias("saved_tokens"),
        "ends_sha256",
    )


def conversation_trie(conversations: DataFrame, block: int = BLOCK, capacity: int = CAPACITY) -> DataFrame:
    """The trie of conversations as they are."""
    turns = written(turns_of(conversations), "placed")
    return nodes(turns, turns.groupBy("conv").agg(F.count("*").alias("n")), block, capacity)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(*rebuilt(written(turns_of(table(spark, sf_dir, "conversations")), "placed")))


SQL = r"""
WITH rows AS (
  SELECT conv_id AS conv, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv, conv - conv % 5 AS base, count(*) AS own,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
             lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h
  FROM rows GROUP BY conv),
heads AS (SELECT c.conv, c.base, c.h, least(c.h, coalesce(b.own, 0)) AS head FROM convs c LEFT JOIN convs b ON b.conv = c.base),
rebuilt AS (
  SELECT h.conv, r.pos, r.role, r.text FROM heads h JOIN rows r ON r.conv = h.base WHERE r.pos < h.h
  UNION ALL SELECT h.conv, h.head + r.pos - h.h, r.role, r.text FROM heads h JOIN rows r ON r.conv = h.conv WHERE r.pos >= h.h),
lists AS (
  SELECT c.conv, coalesce(list({'role': role, 'text': text} ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS turns
  FROM convs c LEFT JOIN rebuilt r USING (conv) GROUP BY c.conv),
prefixes AS (SELECT conv, len(turns) AS n, d AS depth, turns[1:d] AS prefix, turns[1:d - 1] AS above FROM lists, unnest(range(0, len(turns) + 1)) AS t(d)),
nodes AS (
  SELECT depth, prefix, any_value(above) AS above, min(conv) AS conv_id, count(*) AS n_convs,
         CASE WHEN depth = 0 THEN 0 ELSE strlen(any_value(prefix)[depth].text) END AS size,
         coalesce(string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (WHERE n = depth), '') AS ends
  FROM prefixes GROUP BY depth, prefix),
children AS (SELECT depth - 1 AS depth, above AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.prefix = n.prefix),
sums AS (
  SELECT a.d AS depth, prefix[1:a.d] AS prefix, count_if(n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * size) AS BIGINT) AS saved_tokens
  FROM whole, unnest(range(0, depth + 1)) AS a(d) GROUP BY 1, 2)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, sha256(w.ends) AS ends_sha256
FROM whole w JOIN sums s ON s.depth = w.depth AND s.prefix = w.prefix LEFT JOIN whole p ON p.depth = w.depth - 1 AND p.prefix = w.above AND w.depth > 0
"""
