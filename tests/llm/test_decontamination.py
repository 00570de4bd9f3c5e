import random
import re

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from quarry.llm import decontamination
from quarry.llm.decontamination import find_items, longest_alike, op3_decontamination
from tests.llm.conftest import EDGE

WORDS = re.compile(r"[A-Za-z0-9_\u0080-\U0010ffff]+")


@given(st.lists(st.booleans(), max_size=40))
def test_longest_alike(equal):
    e = np.array(equal, dtype=bool)
    i, j = longest_alike(e)
    want = max((b - a for a in range(len(e) + 1) for b in range(a, len(e) + 1) if a == b or e[a:b].mean() >= 0.8 - 1e-9), default=0)
    assert j - i == want and (i == j or e[i:j].mean() >= 0.8 - 1e-9)


def brute(rows, items):
    """All diagonals, with a seed hit of some mask on it."""
    out = set()
    for d, text in rows:
        t = WORDS.findall((text or "").lower())
        for k, item in items:
            q = WORDS.findall((item or "").lower())
            masks = decontamination.MASKS if len(q) >= 12 else ("1" * len(q),) if len(q) >= 5 else ()
            for s in range(-len(q), len(t)):
                pairs = [(i, s + i) for i in range(len(q)) if 0 <= s + i < len(t)]
                equal = [q[i] == t[p] for i, p in pairs]
                hit = any(all(equal[x + m] for m, bit in enumerate(mask) if bit == "1") for mask in masks for x in range(len(equal) - len(mask) + 1))
                if hit:
                    n = max(b - a for a in range(len(equal)) for b in range(a + 1, len(equal) + 1) if sum(equal[a:b]) >= 0.8 * (b - a) - 1e-9)
                    if n >= min(16, len(q)):
                        out.add((d, k))
    return out


def test_against_brute_force(spark, docs):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([40, 30, 12, 8, 5, 4, 20])] + [(20, None), (21, "")]
    rows = []
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.randrange(0, 60))
        if i % 2:
            passage = (rng.choice(items)[1] or "").split()
            for _ in range(len(passage) * (i % 3) // 12):
                passage[rng.randrange(len(passage))] = "sub"
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage[rng.choice([0, 0, 9]) :]
        rows.append((i, " ".join(words).title()))
    want = brute(rows, items)
    tests = docs(items).withColumnRenamed("doc_id", "item_id")
    got = find_items(docs(rows + EDGE), tests).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) > 10
    before = decontamination.BLOCK_WORDS
    decontamination.BLOCK_WORDS = 40
    try:
        again = find_items(docs(rows), tests).collect()
    finally:
        decontamination.BLOCK_WORDS = before
    assert {(r.doc_id, r.item_id) for r in again} == want


def test_empty(spark, docs):
    tests = docs(EDGE).withColumnRenamed("doc_id", "item_id")
    assert find_items(docs([]), tests).count() == 0
    assert find_items(docs(EDGE), docs([]).withColumnRenamed("doc_id", "item_id")).count() == 0


def test_contained_items_are_found(spark):
    sf = "/root/testdata/sf0.01"
    squeeze = lambda t: " ".join(WORDS.findall((t or "").lower()))
    items = [(r.item_id, squeeze(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held = {(r.doc_id, k) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for k, q in items if f" {q} " in f" {squeeze(r.text)} "}
    got = {(r.doc_id, r.item_id) for r in op3_decontamination(spark, sf).collect()}
    assert len(held) > 20 and held <= got
    print(len(held), len(got))
