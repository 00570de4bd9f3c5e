"""A cleaning pipeline over ``documents``: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir), where docs has the columns of ``documents``, and returns
those columns; the last returns the encoded documents. Between stages the rows are written to the
shared folder and read again, so a stage that reads its input several times doesn't redo the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import crc_mod, only, table, written
from quarry.llm.decontamination import without_items
from quarry.llm.language_id import least_scores, of_known_language, train
from quarry.llm.near_duplicates import one_of_each_class
from quarry.llm.repeated_bytes import without_repeats
from quarry.llm.sentence_pieces import round_trip


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters go, and those that are less like a language than 999 in 1,000 labelled
    texts of their size are, measured on rows that didn't train. Null and empty texts have no
    letters. Rows without a language neither train nor measure; repeated rows stay or go together.
    An empty table gives an empty one."""
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    model = train(docs.where(~held_out))
    return of_known_language(docs, model, least_scores(docs.where(held_out), model))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays; of repeated rows one.
    Null and empty texts are equal, so one of them stays. Rows without an id stay where no row of
    their class has one, one for each text. An empty table gives an empty one."""
    return one_of_each_class(docs)


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier are cut out; documents left blank go. Texts of
    less, null and empty ones among them, are left alone. Ids that are null come last; rows of one
    id are ordered by their texts' digest, and repeated rows are cut alike. An empty table gives an
    empty one."""
    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts and items hold nothing;
    repeated rows stay or go together. Without documents, or without items, nothing changes."""
    return without_items(docs, table(spark, sf_dir, "benchmark"), short_items=True)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as SentencePiece ids, decoded again: a row for each row, repeated ones too. A
    null text has null ids, an empty one none. An empty table gives an empty one."""
    import public_tokenizers

    return round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_bytes", repeated_bytes),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

ORACLE_SQL = None  # SQL can't express the stages; tests/llm/test_pipeline.py has them by brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
