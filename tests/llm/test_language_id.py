from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quarry.llm.language_id import bundle, letter_vectors, op6_language_id, predict, train
from tests.llm.conftest import EDGE


def brute(text, dimensions, n):
    clean = "".join(c if c.isalpha() else " " for c in text.lower())
    clean = " " + " ".join(clean.split()) + " "
    total = np.zeros(dimensions)
    for gram, count in Counter(clean[i : i + n] for i in range(len(clean) - n + 1)).items():
        v = np.ones(dimensions)
        for k, c in enumerate(gram):
            v = v * np.roll(letter_vectors(np.array([ord(c) if c != " " else 0]), dimensions)[0], n - 1 - k)
        total += count * v
    return total


def test_bundle_is_the_sum_of_gram_vectors():
    texts = ["Hello, wörld!", "a", "中文 中文字 x1y"]
    got = bundle(texts, np.arange(3), 3, 64, 3)
    for text, row in zip(texts, got):
        assert np.allclose(row, brute(text, 64, 3))


def test_edges(spark, docs):
    model = train(docs([(1, "the cat and the dog"), (2, "der hund und die katze")]).withColumn("lang", F.when(F.col("doc_id") == 1, "en").otherwise("de")))
    got = predict(docs(EDGE).select("doc_id", "text"), model).collect()
    assert len(got) == len(EDGE)
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    empty = train(docs([]).withColumn("lang", F.lit("en")))
    assert {r.lang_pred for r in predict(docs(EDGE).select("doc_id", "text"), empty).collect()} == {"und"}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    r = op6_language_id(spark, sf).where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert r.n > 200 and r.a > 0.97, r
