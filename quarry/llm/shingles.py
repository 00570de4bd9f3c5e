"""Word shingles of whole batches of texts, in numpy.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII characters of the
lower-cased text. A shingle is ``n`` successive words; a text of fewer words is one shingle of all
of them, and one without words has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quarry.llm.common import byte_view, mix64

SHINGLE_WORDS = 5
_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SYMBOLS = mix64(np.arange(1, 257, dtype=np.uint64))
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True

_state: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base^0 ... base^(n-1), modulo 2^64."""
    known = _state.get(str(base))
    if known is None or len(known) < n:
        line = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        line[0] = 1
        with np.errstate(over="ignore"):
            known = _state[str(base)] = np.multiply.accumulate(line)
    return known[:n]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of a text column, in order: hash, number of the text, first and last byte + 1
    (places in the bytes of the lower-cased column)."""
    flat, offsets = byte_view(pc.utf8_lower(column.cast(pa.large_string())))
    n = len(flat)
    if not n:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    inside = _IS_WORD[flat]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]  # a word doesn't run on into the next text
    starts[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_SYMBOLS[flat] * _power(_INVERSE, n), out=sums[1:])
        hashes = mix64((sums[last] - sums[first]) * _power(_BASE, n + 1)[last])
    return hashes, np.searchsorted(offsets, first, side="right") - 1, first, last


def shingle_hashes(column: pa.Array, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every shingle, in order."""
    hashes, owner, _, _ = word_hashes(column)
    if not len(hashes):
        return hashes, owner
    counts = np.bincount(owner, minlength=len(column))
    begin = np.cumsum(counts) - counts
    place = np.arange(len(hashes)) - begin[owner]
    whole = place + words <= counts[owner]
    short = (place == 0) & (counts[owner] < words)
    out = np.zeros(len(hashes), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            there = np.zeros(len(hashes), np.uint64)
            there[: max(0, len(hashes) - k)] = hashes[k:]
            if short.any():
                there[short & (k >= counts[owner])] = 0
            out = mix64(out * _BASE + there + np.uint64(k))
    keep = whole | short
    return out[keep], owner[keep]


def weighted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, owner) with their counts, ascending by owner and hash."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return hashes[at], owner[at], np.diff(at, append=len(hashes))
