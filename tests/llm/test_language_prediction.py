"""Predictions and the pipeline's filter against plain versions."""

import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import language_id
from quarry.llm.language_id import DIMENSIONS, GRAM, least_scores, of_known_language, op6_language_id, train
from tests.llm.test_language_id import brute


def test_small_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    vectors = {r.doc_id: brute(r.text or "", DIMENSIONS, GRAM) if any(c.isalpha() for c in r.text or "") else None for r in rows}
    sums = {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang is not None and vectors[r.doc_id] is not None:
            sums[r.lang] = sums.get(r.lang, 0) + vectors[r.doc_id]
    names = sorted(sums)
    got = {r.doc_id: r for r in op6_language_id(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        v, p = vectors[r.doc_id], got[r.doc_id]
        assert p.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if v is None:
            assert (p.lang_pred, p.score) == ("und", 0)
            continue
        cosines = [float(v @ sums[n] / np.linalg.norm(v) / np.linalg.norm(sums[n])) for n in names]
        best = int(np.argmax(cosines))
        assert abs(p.score - max(0, cosines[best])) < 1e-4 and p.lang_pred == names[best]


def test_least_scores_learned_from_held_out_rows(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SUPPORT", 50)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = train(docs.where("doc_id % 2 = 0"))
    least = least_scores(docs.where("doc_id % 2 = 1"), model)
    assert least and all(0 < v < 1 for v in least.values())
    strange = " ".join("xqzj wkvq zzxx jjqk vvwx".split() * 60)
    two = spark.createDataFrame([(1, strange), (2, None), (3, "12 34")], "doc_id long, text string")
    assert of_known_language(two, model, least).count() == 0
    kept = of_known_language(docs, model, least)
    assert kept.columns == docs.columns and kept.count() >= 0.995 * docs.count()


def test_columns_with_the_operators_names(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumns({c: F.lit("x") for c in ("lang_pred", "score", "node", "_id")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, "/root/testdata/sf0.001")
        assert kept.columns == docs.columns and kept.count(), name


def test_least_scores_measure_every_labelled_row(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id, "predict", lambda docs, model: seen.append(docs.count()) or docs.selectExpr("*", "lang AS lang_pred", "length(text) / 100D AS score"))
    rows = spark.range(150_000).selectExpr("concat('t', id) AS text", "'en' AS lang")
    least = least_scores(rows, None)
    assert seen == [150_000] and least
