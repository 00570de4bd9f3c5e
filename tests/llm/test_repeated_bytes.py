import hashlib
import random

import numpy as np
import pytest

from quarry.llm import repeated_bytes
from quarry.llm.repeated_bytes import op1_repeated_bytes, repeats, suffix_order, without_repeats
from tests.llm.conftest import EDGE


def brute(rows, length=100):
    docs = {(d if d is not None else 2**63 - 1, hashlib.md5((t or "").encode()).digest()[:3]): (t or "").encode() for d, t in rows}
    seen, gone = set(), {}
    for key in sorted(docs):
        data, mask = docs[key], bytearray(len(docs[key]))
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                mask[p : p + length] = b"\1" * length
            seen.add(w)
        gone[key] = mask
    out = []
    for d, t in rows:
        key = (d if d is not None else 2**63 - 1, hashlib.md5((t or "").encode()).digest()[:3])
        mask, data = gone[key], docs[key]
        kept = bytes(c for c, m in zip(data, mask) if not m)
        out.append((d, len(data), sum(mask), sum(m and not (i and mask[i - 1]) for i, m in enumerate(mask)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    passages = ["".join(rng.choices("abcdé ", k=rng.choice([90, 100, 130, 400]))) for _ in range(6)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.2:
            rows.append((i, rng.choice(rows)[1]))
        elif rows and kind < 0.4:
            text = list(rng.choice(rows)[1])
            for _ in range(2):
                if text:
                    text[rng.randrange(len(text))] = "X"
            rows.append((i, "".join(text)))
        else:
            parts = ["".join(rng.choices("abcdé ", k=rng.randrange(0, 300))) for _ in range(3)]
            if kind < 0.8:
                parts.insert(rng.randrange(4), rng.choice(passages) * rng.choice([1, 1, 3]))
            rows.append((i, "".join(parts)))
    rng.shuffle(rows)
    return rows


def test_suffix_order():
    rng = np.random.default_rng(0)
    flat = rng.integers(97, 99, 3000).astype(np.uint8)
    flat[2000:2900] = flat[100:1000]
    starts = rng.permutation(2900)
    order, new = suffix_order(flat, starts, 100)
    strings = [flat[s : s + 100].tobytes() for s in starts[order]]
    assert strings == sorted(strings) and new.tolist() == [i == 0 or strings[i] != strings[i - 1] for i in range(len(strings))]


@pytest.mark.parametrize("seed,partitions", [(1, 8), (2, 40)])
def test_against_brute_force(spark, docs, seed, partitions):
    rows = corpus(seed, 150) + [(5, "same id " * 40), (5, "other text " * 30)] + EDGE
    rows += rows[:3]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = repeats(docs(rows).repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_small_chunks(spark, docs, monkeypatch):
    monkeypatch.setattr(repeated_bytes, "CHUNK", 7)
    rows = corpus(9, 60)
    assert sorted(map(tuple, repeats(docs(rows)).collect()), key=str) == brute(rows)


def test_empty(spark, docs):
    assert repeats(docs([])).count() == 0 and without_repeats(docs([])).count() == 0


def test_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(map(tuple, op1_repeated_bytes(spark, "/root/testdata/sf0.001").collect()), key=str) == brute(rows)


def test_other_columns_stay(spark):
    text = "é" * 40 + "abcdefghij" * 15
    rows = [(1, text, "en", 5), (2, "new " + text + " tail", "de", 6), (3, text, "fr", 7), (4, None, None, None)]
    got = {r.doc_id: r for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")).collect()}
    assert set(got) == {1, 2, 4} and got[2].lang == "de" and got[2].text == "new  tail" and got[2].n_chars == 9 and got[1].n_chars == len(got[1].text)
