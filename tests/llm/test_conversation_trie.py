import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.llm.conversation_trie import SQL, conversation_trie, ends_digests, nodes, op11_conversation_trie, rebuilt, turns_of

SCHEMA = "conv_id long, turn long, role string, text string"


def sequences(rows):
    """conv -> [(role, text)], by the order that the operator states."""
    out = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            out[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16], (role, text)))
    return {c: [x[-1] for x in sorted(v)] for c, v in out.items()}


def rebuild(plain):
    out = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = plain.get(c - int(c % 5 if c >= 0 else -(-c % 5)), [])[:h] + own[h:]
    return out


def expected(plain):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in plain.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    for p, m in members.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        yield min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha


def made(seed, n, vocabulary, longest):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        like = [x for x in rows if x[0] == r.randrange(n)] if r.random() < 0.6 else []
        turns = like[: r.randrange(len(like) + 1)] if like else []
        turns = [(t[2], t[3]) for t in turns] + [(r.choice(["user", None]), r.choice(vocabulary)) for _ in range(r.randrange(longest))]
        rows += [(c, i, role, text) for i, (role, text) in enumerate(turns)] or [(c, None, None, None)]
    return rows


EDGE = [(1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (2, 1, "a", "ab"), (7, 1, "aa", "b"), (-3, 1, "", "x"), (-5, 0, "u", "base"), (-5, 1, "u", "é" * 3000), (None, 0, "user", "lost"), (-1, 0, "u", "z"), (6, None, "u", "early"), (6, -2, "u", "later")]


@pytest.mark.parametrize("block, capacity", [(3, 2), (64, 4096)])
def test_against_brute_force(spark, block, capacity):
    rows = EDGE + [(c + 100, *x) for c, *x in made(block, 60, ["", "a", "b", "é" * 9], 9)] + [(1000 + c, i, "u", f"t{i}") for c in range(3) for i in range(10 + c // 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("conv", "id", "ids", "n", "h1", "position", "block")}).repartition(3)
    got = conversation_trie(df, block, capacity).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected(sequences(rows)), key=str)
    got = nodes(*rebuilt(turns_of(df)), block, capacity).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected(rebuild(sequences(rows))), key=str)


def test_one_long_conversation_and_its_copy(spark):
    rows = [(c, i, "u", str(i)) for c in (4, 9) for i in range(300)] + [(9, 300, "u", "more"), (11, 0, "u", "0")]
    got = conversation_trie(spark.createDataFrame(rows, SCHEMA), block=16, capacity=1).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected(sequences(rows)), key=str)


def test_empty(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0


def test_digest_of_a_hot_key(spark):
    ends = spark.range(50_000).select(F.lit(1).cast("long").alias("e1"), F.floor(F.col("id") % 7 / 6).alias("e2"), F.col("id").alias("conv"))
    want = {e: hashlib.sha256(",".join(str(i) for i in range(50_000) if i % 7 // 6 == e).encode()).hexdigest() for e in (0, 1)}
    assert {r.e2: r.ends_sha256 for r in ends_digests(ends).collect()} == want


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = duck.execute(SQL)
    names = [d[0] for d in want.description]
    got = op11_conversation_trie(spark, sf).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)
