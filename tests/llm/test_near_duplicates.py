import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.near_duplicates import near_duplicates, op9_near_duplicates, signatures
from quarry.llm.shingles import shingle_hashes, weighted
from tests.llm.conftest import EDGE

WORDS = re.compile(r"[A-Za-z0-9_\u0080-\U0010ffff]+")


def shingles(text):
    w = WORDS.findall((text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(rows):
    rows = list(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or (sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def test_shingles():
    texts = ["The cat, the CAT the cat the cat", None, "", "one two", "été à la plage oui!", "x.y"]
    hashes, owner, counts = weighted(*shingle_hashes(pa.array(texts)))
    for i, t in enumerate(texts):
        assert sorted(counts[owner == i]) == sorted(shingles(t).values())


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 300).astype(np.uint64)
    wa, wb = rng.integers(0, 9, 300), rng.integers(0, 9, 300)
    truth = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    a, b = wa > 0, wb > 0
    got = signatures(np.concatenate([keys[a], keys[b]]), np.repeat([0, 1], [a.sum(), b.sum()]), np.concatenate([wa[a], wb[b]]), 2, 4000)
    assert abs((got[0] == got[1]).mean() - truth) < 0.04


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            words = (rng.choice(out)[1] or "").split()
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append((i, " ".join(words)))
        else:
            out.append((i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 60, 150, 300])))))
    return out


def test_against_brute_force(spark, docs):
    rows = corpus(3, 220) + EDGE
    got = near_duplicates(docs(rows).repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_edges(spark, docs):
    assert near_duplicates(docs([])).count() == 0
    got = near_duplicates(docs(EDGE)).collect()
    assert sorted(map(tuple, got), key=str) == brute(EDGE)


def test_components_of_a_chain(spark):
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.range(100, 105).select(F.lit(100).cast("long"), "id"))
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 105)}}


def test_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(map(tuple, op9_near_duplicates(spark, "/root/testdata/sf0.001").collect()), key=str) == brute(rows)
