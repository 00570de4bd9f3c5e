import time

import numpy as np
import public_tokenizers
import sentencepiece

from quarry.llm.sentence_pieces import MARK, PieceModel, round_trip

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def trie_nodes(words):
    return len({w[: i + 1] for w in words for i in range(len(w))})


def test_each_trie_node_is_scored_once():
    model = PieceModel(PATH)
    words = sorted({MARK + w for w in "the then them thence there therein other others otherwise a an and andes".split()})
    model.segment(words)
    assert model.scored == trie_nodes(words) < sum(map(len, words)) / 2


def test_runs_of_blanks_take_linear_time():
    model = PieceModel(PATH)
    for text in (" " * 3001 + "x", "a" + " " * 777 + "b  c", "ab" * 2000):
        assert np.frombuffer(model.encode([text])[0], "<i4").tolist() == LIBRARY.encode(text)
    began = time.time()
    ids = np.frombuffer(model.encode([" " * 1_000_000 + "end"])[0], "<i4")
    assert model.decode(ids) == " " * 1_000_000 + "end" and time.time() - began < 30


def test_ids_come_out(spark, docs):
    rows = [(1, "Some  text"), (2, None), (3, "")]
    got = {r.doc_id: r for r in round_trip(docs(rows), PATH).collect()}
    assert got[1].ids == LIBRARY.encode("Some  text") and got[2].ids is None and got[3].ids == []
