import random

import corpus_pipeline
from quarry.llm.decontamination import MASKS, SPAN, find_items, masks_for, op3_decontamination
from tests.llm.test_decontamination import WORDS


def least_replaced(masks, most):
    """For each n up to ``most``: how many of n words must be replaced so that no mask hits."""
    span = max(map(len, masks))
    fixed = [int(m, 2) for m in masks]
    states, out = {0: 0}, {}
    for n in range(1, most + 1):
        grown = {}
        for state, cost in states.items():
            for equal in (0, 1):
                now = state << 1 | equal
                if not any(now & m == m for m in fixed):
                    key = now & (1 << span - 1) - 1
                    grown[key] = min(grown.get(key, n), cost + 1 - equal)
        states = {k: c for k, c in grown.items() if c <= n // 5 + 3}
        out[n] = min(states.values(), default=n)
    return out


def test_masks_hit_every_stretch():
    # beyond 44 words some 15 successive ones have 3 replaced at most, which the first four masks hit
    least = least_replaced(MASKS, 45)
    assert all(least[n] > n // 5 for n in range(SPAN, 46))
    assert least_replaced(MASKS[:4], 15)[15] > 3
    for n in range(1, SPAN):
        assert least_replaced(masks_for(n, True), n)[n] > n // 5


def brute(rows, items):
    """All diagonals, whether or not a seed hits."""
    out = set()
    for d, text in rows:
        t = WORDS.findall((text or "").lower())
        for k, item in items:
            q = WORDS.findall((item or "").lower())
            for s in range(1 - len(q), len(t)):
                equal = [q[i] == t[s + i] for i in range(len(q)) if 0 <= s + i < len(t)]
                if any(sum(equal[a:b]) >= 0.8 * (b - a) - 1e-9 for a in range(len(equal)) for b in range(a + min(16, len(q)), len(equal) + 1)):
                    out.add((d, k))
    return out


def passages(rng, items):
    """Texts with an item each, of which as many words are replaced as may be, or one more."""
    rows = []
    for i in range(120):
        passage = items[i % len(items)][1].split()
        for at in rng.sample(range(len(passage)), min(len(passage), len(passage) // 5 + (i % 4 == 3))):
            passage[at] = "sub"
        rows.append((i, " ".join([*rng.choices(VOCABULARY, k=rng.randrange(8)), *passage, *rng.choices(VOCABULARY, k=rng.randrange(8))])))
    return rows


VOCABULARY = [f"v{i}" for i in range(300)]


def test_every_alike_item_is_found(spark, docs, tmp_path):
    rng = random.Random(8)
    items = [(n, " ".join(rng.choices(VOCABULARY, k=n))) for n in [*range(1, 23), 25, 30, 44]]
    rows = passages(rng, items)
    want = brute(rows, items)
    tests = docs(items, extra=False).withColumnRenamed("doc_id", "item_id")
    got = {(r.doc_id, r.item_id) for r in find_items(docs(rows), tests, short_items=True).collect()}
    assert got == want and {k for _, k in want} == {k for k, _ in items}
    docs(rows, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    tests.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {(r.doc_id, r.item_id) for r in op3_decontamination(spark, str(tmp_path)).collect()} == want
    kept = {r.doc_id for r in corpus_pipeline.decontamination(spark, docs(rows), str(tmp_path)).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in want}
