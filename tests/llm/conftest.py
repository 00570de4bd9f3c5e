import pytest


@pytest.fixture()
def docs(spark):
    """(rows) -> documents table with a column that clashes with names used inside operators."""

    def make(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit("clash") for c in ("lang", "source", "n_chars", "start", "hash", "key", "weight", "class_id")})
        return df

    return make


EDGE = [(1, None), (2, ""), (3, "a"), (3, "a"), (7, "  two  spaces \n x "), (9, "été " * 3000), (11, "word " * 20000), (12, "中文 テスト é"), (None, "no id")]
