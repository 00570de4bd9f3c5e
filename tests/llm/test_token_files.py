import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm.common import scratch_path
from quarry.llm.token_files import UnitEncoder, read_token_files, units, write_token_files
from tests.llm.conftest import EDGE

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN, ENCODER = Tokenizer.from_file(PATH), UnitEncoder(PATH, "<u2")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab  \n\t 　.'sé中1<|>")) | st.characters(codec="utf-8"), max_size=40))
def test_units_encode_as_the_whole(text):
    assert "".join(units(text)) == text
    assert np.frombuffer(ENCODER.encode([text])[0], "<u2").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab.'sé1<|>", min_size=1, max_size=6), min_size=1, max_size=8), st.integers(0, 255))
def test_lines_of_words_encode_as_the_whole(words, ends):
    text = "".join(w + (" ", "\n")[ends >> i & 1] for i, w in enumerate(words))[:-1]
    assert np.frombuffer(ENCODER.encode([text])[0], "<u2").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_special_token_text():
    text = "a <|endoftext|>b <|endoftext|> c"
    assert np.frombuffer(ENCODER.encode([text])[0], "<u2").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_files_against_brute_force(spark, docs):
    folder = scratch_path(spark, "t")
    got = read_token_files(write_token_files(docs(EDGE).repartition(3), folder, PATH), folder).collect()
    rows, start = [], 0
    for doc_id, text in sorted(EDGE, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*PLAIN.encode(text or "", add_special_tokens=False).ids, 0]
        rows.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in sorted(got, key=lambda r: r.position)] == rows


def test_empty(spark, docs):
    folder = scratch_path(spark, "t")
    assert read_token_files(write_token_files(docs([]), folder, PATH), folder).count() == 0
