import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm.sentence_pieces import PieceModel, decode, encode, round_trip
from tests.llm.conftest import EDGE

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL, LIBRARY = PieceModel(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abethinos  \n\t.,'é中1<>")) | st.characters(codec="utf-8", exclude_characters="▁\0"), max_size=40))
def test_ids_are_those_of_the_library(text):
    ids = np.frombuffer(MODEL.encode([text])[0], "<i4")
    assert ids.tolist() == LIBRARY.encode(text)
    assert MODEL.decode(ids) == text


def test_corpus_against_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in round_trip(docs, PATH).collect()}
    for r in docs.limit(200).collect():
        ids = LIBRARY.encode(r.text)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32, got[r.doc_id].exact) == (len(ids), zlib.crc32(np.array(ids, "<i4").tobytes()), True)


def test_unigram_viterbi_is_the_best_segmentation():
    m = PieceModel.__new__(PieceModel)
    m.score = {"▁": -2.0, "a": -1.5, "b": -1.6, "▁a": -2.2, "ab": -2.0, "aba": -4.9, "ba": -2.1}
    m.endings, m.merges, m.pairs = {p[k:] for p in m.score for k in range(len(p))}, False, {}

    def best(word):
        if not word:
            return 0.0, []
        return max((best(word[: -len(p)])[0] + s, best(word[: -len(p)])[1] + [p]) for p, s in m.score.items() if word.endswith(p))

    words = sorted(["▁abab", "▁aba", "▁abaab", "▁b", "▁abba"])
    for word, pieces in zip(words, m.segment(words)):
        assert pieces == best(word)[1] and abs(sum(m.score[p] for p in pieces) - best(word)[0]) < 1e-9


def test_edges(spark, docs):
    back = decode(encode(docs(EDGE), PATH), PATH).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(tuple, back), key=key) == sorted(EDGE, key=key)
    assert encode(docs([]), PATH).count() == 0 and all(r.exact for r in round_trip(docs(EDGE), PATH).collect())
