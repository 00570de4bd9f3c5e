import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm.common import code_points
from quarry.llm.winnowing import fingerprints, gram_hashes, winnow
from tests.llm.conftest import EDGE


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab", max_size=60), st.integers(1, 9), st.integers(1, 7))
def test_winnow_is_the_rightmost_minimum_of_each_window(text, k, w):
    h = gram_hashes(code_points(text), k).tolist()
    grams = [text[i : i + min(k, len(text))] for i in range(len(h))]
    assert len(h) == (0 if not text else len(text) - min(k, len(text)) + 1)
    assert all((h[i] == h[j]) == (grams[i] == grams[j]) for i in range(len(h)) for j in range(len(h)))
    w = min(w, len(h)) if h else 1
    want = sorted({max(range(i, i + w), key=lambda j: (-h[j], j)) for i in range(len(h) - w + 1)}) if h else []
    got, at = winnow(code_points(text), k, w)
    assert at.tolist() == want and got.tolist() == [h[i] for i in want]


def test_match_guarantee():
    shared = "0123456789" * 7
    a, b = winnow(code_points("x" * 50 + shared), 24, 40)[0], winnow(code_points(shared + "yz" * 40), 24, 40)[0]
    assert np.intersect1d(a, b).size


def expected(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = (set(winnow(code_points(x))[0].tolist()) for x in (text, edited, following))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        yield doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), like(a, b), like(a, c)


def test_against_brute_force(spark, docs):
    for rows in (EDGE, EDGE[1:2], EDGE[:2]):
        got = fingerprints(docs(rows).repartition(4)).collect()
        key = lambda r: (str(r[0]), r[1], r[2])
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=key) == sorted(expected(rows), key=key)
        assert all(len(r.fingerprint) == 8 * len(r.positions) for r in got)
    assert fingerprints(docs([])).count() == 0
