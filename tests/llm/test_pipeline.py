import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_decontamination import brute as brute_items
from tests.llm.test_near_duplicates import brute as brute_classes

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def without_repeats(rows, length=100):
    seen, out = set(), []
    for d, t in sorted(rows):
        data = t.encode()
        mask = bytearray(len(data))
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                mask[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, m in zip(data, mask) if not m).decode(errors="ignore")
        if kept.strip() or not any(mask):
            out.append((d, kept))
    return out


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in ("wo", "sla", "tri", "kon", "mu") for b in ("rd", "ndel", "po", "ska", "ri", "te")]
    items = [(i, " ".join(rng.choices(vocabulary, k=25))) for i in range(3)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    rows = []
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.randrange(10, 120))
        if i % 7 == 1:
            words[3:3] = passage.split()
        if i % 9 == 2:
            words[5:5] = rng.choice(items)[1].split()
        text = " ".join(words)
        if i % 5 == 3:
            near = rng.choice(rows)[1].split(" ")
            near[len(near) // 2] = "changed"
            text = " ".join(near)
        rows.append((i, "12 34 %%" if i == 50 else text))
    spark.createDataFrame([(d, t, "en", "src", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    want = [r for r in rows if any(c.isalpha() for c in r[1])]
    kept = {d for d, c in brute_classes(want) if d == c}
    want = without_repeats([r for r in want if r[0] in kept])
    held = {d for d, _ in brute_items(want, items)}
    want = [r for r in want if r[0] not in held]
    ids = {d: LIBRARY.encode(t) for d, t in want}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 20 < len(got) < 55
    assert {(r.doc_id, r.n_tokens, r.ids_crc32, r.exact) for r in got} == {(d, len(x), zlib.crc32(np.array(x, "<i4").tobytes()), True) for d, x in ids.items()}


def test_stages_keep_the_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_language_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    gone = docs.join(corpus_pipeline.language(spark, docs, sf), "doc_id", "left_anti")
    assert gone.where(F.col("text").rlike(r"\p{L}{3}")).count() <= 3
