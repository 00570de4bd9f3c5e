"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over successive words that looks at some of them and ignores the others, so
a passage still has equal seeds where words have been replaced. The seeds of the test items are
joined with those of the training texts. Around each hit, along its diagonal, item and text are
compared word by word, and the longest stretch with at least ``IDENTITY`` equal words is measured.
A text holds an item if that stretch has ``WORDS`` words, or the whole item if that is shorter.

``MASKS`` leave out no such stretch of an item of ``SPAN`` words or more: cut into threes, 15 words
with up to 3 replaced have two whole threes, at a distance of 3, 6, 9 or 12. Only stretches of 20
words can have 4 in each of their 15 words; those have threes at a distance of 13. Shorter items
have masks of their own with ``short_items``, down to single words, which must be equal. Without it
items of ``SHORTEST`` words up to ``SPAN`` are looked up whole and shorter ones match nothing.

Test items come to the tasks in blocks of at most ``BLOCK_WORDS`` words, and every text meets every
block; no training hash is shuffled. Null and empty texts and items, and items without words, match
nothing. Of equal windows that follow each other on a diagonal only the first is looked at, so the
work on repeated words grows with the diagonals, not with the hits. Repeated items are items of their own; repeated rows of texts
give repeated results. Other columns are ignored. An empty table on either side gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import mix64, only, released, slices, table
from quarry.llm.shingles import word_hashes

MASKS = tuple("111" + "0" * (n - 3) + "111" for n in (3, 6, 9, 12, 13))
SPAN = 12
WORDS = 16
IDENTITY = 0.8
SHORTEST = 5
BLOCK_WORDS = 2_000_000
CELLS = 1 << 21  # places that are compared at once
FIVE = ("1111", "11101", "11011", "10111")  # four of five words
TWOS = ("1111", "110011", "11000011")  # of 6 to 11 words with one in five replaced

_FACTORS = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def seeds(words: np.ndarray, owner: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the masked windows that lie in one text, and their first words."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.full(n, int(mask, 2) + len(mask) * 65536, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k, bit in enumerate(mask):
            if bit == "1":
                total += words[k : k + n] * _FACTORS[k]
    at = np.flatnonzero(owner[:n] == owner[len(mask) - 1 :])
    return mix64(total[at]), at


def masks_for(n: int, short_items: bool) -> tuple[str, ...]:
    """The masks that look for items of ``n`` words."""
    if n >= SPAN:
        return MASKS
    if short_items:
        return () if n < 1 else ("1" * n,) if n < 5 else FIVE if n == 5 else TWOS
    return ("1" * n,) if n >= SHORTEST else ()


def _before(h: np.ndarray, at: np.ndarray, owner: np.ndarray, none: int) -> np.ndarray:
    """The hash of the window one word earlier in the same text; ``none`` where there is none."""
    out = np.full(len(h), none, dtype=np.uint64)
    follows = np.flatnonzero((at[1:] == at[:-1] + 1) & (owner[at[1:]] == owner[at[:-1]])) + 1
    out[follows] = h[follows - 1]
    return out


class Seeds:
    """The windows of test items under one mask, sorted by hash and by the hash of the window before."""

    def __init__(self, words: np.ndarray, owner: np.ndarray, place: np.ndarray, mask: str):
        h, at = seeds(words, owner, mask)
        before = _before(h, at, owner, 0)
        self.mask = mask
        self.hashes, number = np.unique(h, return_inverse=True)
        self.befores, rank = np.unique(before, return_inverse=True)
        both = number << 32 | rank
        order = np.argsort(both, kind="stable")
        self.both, self.place = both[order], place[at][order]

    def starts(self, words: np.ndarray, owner: np.ndarray, seen: np.ndarray, shift: np.uint64):
        """(places in the texts, places in the items), in parts of bounded size: equal windows with
        no equal ones just before them. A run of equal windows on a diagonal gives its first only,
        so repeated words give as many as the texts and items are long, not their product."""
        h, at = seeds(words, owner, self.mask)
        if not len(h) or not len(self.hashes):
            return
        before = _before(h, at, owner, 1)
        near = seen[(h >> shift).astype(np.int64)]
        h, at, before = h[near], at[near], before[near]
        number = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        same = self.hashes[number] == h
        at, before, number = at[same], before[same], number[same]
        rank = np.minimum(np.searchsorted(self.befores, before), len(self.befores) - 1)
        known = self.befores[rank] == before
        low, high = np.searchsorted(self.both, number << 32), np.searchsorted(self.both, (number + 1) << 32)
        skip, resume = (np.where(known, np.searchsorted(self.both, number << 32 | rank, side), low) for side in ("left", "right"))
        first, many = np.concatenate([low, resume]), np.concatenate([skip - low, high - resume])
        where = np.concatenate([at, at])
        first, where, many = (x[many > 0] for x in (first, where, many))
        total = np.cumsum(many)
        i = 0
        while i < len(many):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + CELLS, side="right")))
            n = many[i:j]
            yield np.repeat(where[i:j], n), self.place[np.repeat(first[i:j], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            i = j


class Index:
    """The seeds of a block of test items."""

    def __init__(self, items: list[tuple[int, str]], short_items: bool = False):
        self.ids = [i for i, _ in items]
        words, owner, _, _ = word_hashes(pa.array([t or "" for _, t in items], pa.string()))
        self.words, self.owner = words, owner
        self.count = np.bincount(owner, minlength=len(items))
        self.begin = np.cumsum(self.count) - self.count
        lengths = self.count[owner] if len(owner) else owner
        sought: dict[str, list[int]] = {}
        for n in np.unique(self.count).tolist():
            for mask in masks_for(n, short_items):
                sought.setdefault(mask, []).append(n)
        self.seeds = []
        for mask, sizes in sought.items():
            use = np.isin(lengths, sizes)
            self.seeds.append(Seeds(words[use], owner[use], np.flatnonzero(use), mask))
        bits = max(16, int(np.ceil(np.log2(max(1, len(words)) * 8))))
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, dtype=bool)
        for s in self.seeds:
            self.seen[(s.hashes >> self.shift).astype(np.int64)] = True

    def diagonals(self, words: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Distinct (text, item, place in the texts' words of the item's first word), as rows."""
        found = [np.zeros((0, 3), np.int64)]
        for s in self.seeds:
            for where, word in s.starts(words, owner, self.seen, self.shift):
                item = self.owner[word]
                found.append(_distinct(np.stack([owner[where], item, where - (word - self.begin[item])], axis=1)))
        return _distinct(np.concatenate(found))


def _distinct(rows: np.ndarray) -> np.ndarray:
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    return rows[new]


def longest_alike_rows(equal: np.ndarray, inside: np.ndarray, identity: float = IDENTITY) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the first and last + 1 of the longest stretch, all ``inside``, with a share of
    ``identity`` equal words; the first of equally long ones. In whole numbers: an equal word is
    worth q - p and another one -p, where identity is p / q, a place that isn't inside costs more
    than all words are worth, and a stretch will do if its sum isn't negative."""
    share = Fraction(identity).limit_denominator(1000)
    rows, n = equal.shape
    most = (n + 1) * share.denominator
    value = np.zeros((rows, n + 1), dtype=np.int64)
    np.cumsum(np.where(inside, equal * share.denominator - share.numerator, -most), axis=1, out=value[:, 1:])
    base = np.arange(rows, dtype=np.int64)[:, None] * (2 * (n + 1) * most)
    # the first start with a value as low as the end's, by one search in all rows' falling minima
    least = (base - np.minimum.accumulate(value, axis=1)).ravel()
    start = np.searchsorted(least, (base - value).ravel()).reshape(rows, n + 1) - np.arange(rows)[:, None] * (n + 1)
    end = np.argmax(np.arange(n + 1) - start, axis=1)
    return start[np.arange(rows), end], end


def longest_alike(equal: np.ndarray, identity: float = IDENTITY) -> tuple[int, int]:
    """``longest_alike_rows`` of one row, all of it inside."""
    first, last = longest_alike_rows(equal[None], np.ones((1, len(equal)), dtype=bool), identity)
    return int(first[0]), int(last[0])


def indexes(items: DataFrame, short_items: bool = False) -> Iterator[Index]:
    """The blocks of the test items, one at a time."""
    tests = only(items, item_id="long", text="string")
    n_words = tests.agg(F.sum(F.length("text"))).first()[0] or 0  # a word has a character at least
    n_blocks = max(1, -(-int(n_words) // (3 * BLOCK_WORDS)))
    blocks = [tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b) for b in range(n_blocks)]
    for block in blocks:
        yield Index([tuple(r) for r in block.collect()], short_items)


def stretches(texts: pa.Array, index: Index) -> dict[tuple[int, int], tuple]:
    """(text, item) -> (words, equal words, -first word in the text, -first word in the item)."""
    words, owner, _, _ = word_hashes(texts.fill_null(""))
    count = np.bincount(owner, minlength=len(texts))
    begin = np.cumsum(count) - count
    best: dict[tuple[int, int], tuple] = {}
    rows = index.diagonals(words, owner)
    sizes = index.count[rows[:, 1]]
    rows = rows[np.argsort(sizes, kind="stable")]  # so that items of one size are compared together
    sizes = np.sort(sizes)
    i = 0
    while i < len(rows):
        j = i + max(1, min(CELLS // max(1, int(sizes[i])), int(np.searchsorted(sizes, max(64, 2 * int(sizes[i]))) - i)))
        text, item, start = rows[i:j].T
        i = j
        place = np.arange(index.count[item].max())
        there = start[:, None] + place
        inside = (place < index.count[item][:, None]) & (there >= begin[text][:, None]) & (there < (begin[text] + count[text])[:, None])
        equal = inside & (words[np.where(inside, there, 0)] == index.words[np.where(inside, index.begin[item][:, None] + place, 0)])
        least = np.minimum(WORDS, index.count[item])
        some = np.flatnonzero(equal.sum(axis=1) >= IDENTITY * least - 1e-9)
        low, high = longest_alike_rows(equal[some], inside[some])
        n_equal = np.concatenate([np.zeros((len(some), 1), np.int64), np.cumsum(equal[some], axis=1)], axis=1)
        good = np.flatnonzero(high - low >= least[some])
        for k in good.tolist():
            row = some[k]
            a, b = int(low[k]), int(high[k])
            found = (b - a, int(n_equal[k, b] - n_equal[k, a]), -int(start[row] + a - begin[text[row]]), -a)
            key = (int(text[row]), int(item[row]))
            if found > best.get(key, ()):
                best[key] = found
    return best


def find_items(documents: DataFrame, items: DataFrame, short_items: bool = False) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words, n_equal): for each text and each item that it
    holds, the longest stretch: its first word in both, its length and its equal words."""
    docs = only(documents, doc_id="long", text="string")
    found = [_find(docs, index) for index in indexes(items, short_items)]
    return functools.reduce(DataFrame.unionByName, found)


def without_items(documents: DataFrame, items: DataFrame, short_items: bool = False) -> DataFrame:
    """``documents``, all columns, without those that hold an item."""
    place = documents.columns.index("text")
    for index in indexes(items, short_items):

        @released("quarry.llm.shingles")
        def run(batches, index=index):
            for batch in slices(batches, "text"):
                held = {text for text, _ in stretches(batch.column(place), index)}
                yield batch.filter(pa.array([i not in held for i in range(batch.num_rows)], pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
    return documents


def _find(docs: DataFrame, index: Index) -> DataFrame:
    @released("quarry.llm.shingles")
    def run(batches):
        for batch in slices(batches, "text"):
            ids = batch.column(0).to_pylist()
            best = stretches(batch.column(1), index)
            if best:
                rows = [(ids[t], index.ids[k], -p, -q, n, e) for (t, k), (n, e, p, q) in best.items()]
                names = ["doc_id", "item_id", "doc_word", "item_word", "n_words", "n_equal"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    return docs.mapInArrow(run, "doc_id long, item_id long, doc_word long, item_word long, n_words long, n_equal long")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_items=True)
