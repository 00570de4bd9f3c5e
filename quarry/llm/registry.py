"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from quarry.llm import chat_rotation, conversation_trie, fill_in_middle
from quarry.llm.chat_rotation import op7_chat_rotation
from quarry.llm.conversation_trie import op11_conversation_trie
from quarry.llm.decontamination import op3_decontamination
from quarry.llm.fill_in_middle import op13_fill_in_middle
from quarry.llm.language_id import op6_language_id
from quarry.llm.mixture import op12_mixture
from quarry.llm.near_duplicates import op9_near_duplicates
from quarry.llm.repeated_bytes import op1_repeated_bytes
from quarry.llm.sentence_pieces import op10_sentence_pieces
from quarry.llm.token_files import op2_token_files
from quarry.llm.toxicity import op8_toxicity
from quarry.llm.url_filter import op4_url_filter
from quarry.llm.winnowing import op5_winnowing

_QUERIES = [
    op1_repeated_bytes,
    op2_token_files,
    op3_decontamination,
    op4_url_filter,
    op5_winnowing,
    op6_language_id,
    op7_chat_rotation,
    op8_toxicity,
    op9_near_duplicates,
    op10_sentence_pieces,
    op11_conversation_trie,
    op12_mixture,
    op13_fill_in_middle,
]
_SQL = {"op7_chat_rotation": chat_rotation.SQL, "op11_conversation_trie": conversation_trie.SQL, "op13_fill_in_middle": fill_in_middle.SQL}


def queries():
    return {f.__name__: f for f in _QUERIES}


def oracle_sql():
    return dict(_SQL)
