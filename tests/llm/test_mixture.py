import re
from collections import defaultdict
from fractions import Fraction
from itertools import product

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm.mixture import fit, knapsack, mix, op12_mixture, word_counts
from tests.llm.conftest import EDGE

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t\x0b\x1cé\x85 ", max_size=20)), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    assert word_counts(pa.array(texts, pa.string())).tolist() == [len(WORD.findall(t or "")) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(0, 3), min_size=1, max_size=4), st.floats(0, 40))
def test_knapsack_finds_the_nearest_sum(counts, budget):
    lengths, n = np.array([*counts]), np.array([*counts.values()])
    got = knapsack(lengths, n, budget, 60)
    sums = [sum(a * b for a, b in zip(lengths, c)) for c in product(*(range(x + 1) for x in n))]
    assert all(got <= n) and min(abs(s - budget) for s in sums if s <= 60) == abs(int(lengths @ got) - budget)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 300), st.integers(0, 50), min_size=1, max_size=30), st.floats(0, 1), st.integers(1, 200))
def test_fit_is_near_and_takes_at_most_all(counts, share, limit):
    lengths, n = np.array([*counts]), np.array([*counts.values()])
    budget = share * float(lengths @ n)
    got = fit(lengths, n, budget, limit)
    assert all(got >= 0) and all(got <= n)
    assert abs(float(lengths @ got) - budget) <= max(lengths) / 2 + 1e-6


def exact_targets(size):
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(size.values()), set()
    while True:
        w = sum(weight[s] for s in names if s not in stopped)
        left = total - sum(3 * size[s] for s in stopped)
        over = {s for s in names if s not in stopped and Fraction(weight[s] * left, w) > 3 * size[s]} if w else set()
        if not over:
            return {s: Fraction(3 * size[s]) if s in stopped else Fraction(weight[s] * left, w) for s in names}
        stopped |= over


def check(rows, got):
    size = defaultdict(int)
    for _, s, t in rows:
        size[s] += len(WORD.findall(t or ""))
    target = exact_targets(size)
    taken = defaultdict(int)
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.size, str(r.source)) for r in got) == sorted((str(d), len(WORD.findall(t or "")), str(s)) for d, s, t in rows)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - float(target[r.source])) < 1e-6 and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    return {s: taken[s] - float(target[s]) for s in size}


def test_against_brute_force(spark):
    texts = [(d, s, t) for s in ("b", "a", None, "", "é", "z") for d, t in EDGE]
    many = [(i, ("big", "mid", "tiny", "long")[min(3, i % 40)], "w " * (i % 90 + 1)) for i in range(900)] + [(5000 + i, "long", "x " * 30000) for i in range(3)]
    for rows in (texts, many, EDGE_ALONE):
        df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit(1) for c in ("size", "part", "draw", "target", "more")}).repartition(5)
        off = check(rows, mix(df).collect())
        assert rows is not many or all(abs(v) <= (1 if s != "long" else 30000 / 2) for s, v in off.items()), off
        if rows is many:
            assert sorted(map(str, mix(df).collect())) == sorted(map(str, mix(df.repartition(3)).collect()))
    assert mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


EDGE_ALONE = [(1, "a", None), (2, "b", "  "), (3, None, "")]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()]
    got = mix(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    off = check(rows, got)
    for s in {r.source for r in got}:  # ten documents: all sums
        mine = [r for r in got if r.source == s]
        whole = min(r.copies for r in mine)
        sums = np.array([sum(c) for c in product(*((0, r.size) for r in mine))]) + whole * mine[0].source_size
        assert abs(off[s]) <= np.min(np.abs(sums - mine[0].target)) + 1e-6
    thin = op12_mixture(spark, sf).collect()
    assert sorted((r.doc_id, r.size * r.copies) for r in got) == sorted((r.doc_id, r.taken) for r in thin)
