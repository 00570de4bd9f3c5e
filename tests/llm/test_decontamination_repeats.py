import random
import time

import pyarrow as pa

from quarry.llm.decontamination import Index, find_items, stretches


def test_repeated_words_take_linear_hits():
    for words, item in ((200_000, 500), (20_000, 200)):
        began = time.time()
        got = stretches(pa.array(["word " * words]), Index([(1, "word " * item)], True))
        assert got == {(0, 0): (item, item, 0, 0)} and time.time() - began < 60


def test_periodic_texts_against_all_diagonals(spark, docs):
    rng = random.Random(8)
    items = [(1, "a b c " * 10), (2, "a " * 30), (3, "a a b " * 7 + "c"), (4, "b a")]
    rows = []
    for i in range(40):
        words = rng.choice(["a b c ", "a ", "a a b ", "b a "]).split() * rng.randrange(1, 25)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice("abx")
        rows.append((i, " ".join(words)))
    want = set()
    for d, text in rows:
        t = text.split()
        for k, item in items:
            q = item.split()
            for s in range(-len(q), len(t)):
                equal = [q[x] == t[s + x] for x in range(len(q)) if 0 <= s + x < len(t)]
                n = max((b - a for a in range(len(equal)) for b in range(a + 1, len(equal) + 1) if sum(equal[a:b]) >= 0.8 * (b - a) - 1e-9), default=0)
                if n >= min(16, len(q)):
                    want.add((d, k))
    got = {(r.doc_id, r.item_id) for r in find_items(docs(rows), docs(items).withColumnRenamed("doc_id", "item_id"), True).collect()}
    assert got == want
