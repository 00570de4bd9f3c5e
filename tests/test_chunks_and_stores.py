"""Chunks with overlap, hash embeddings, replaced documents and the index, against plain versions."""

import hashlib
import math
import random
import re
from pathlib import Path

from pyspark.sql import functions as F

from quarry.functions.embedding import hash_embedding
from quarry.operators.chunking import overlapped, pack, paragraphs
from quarry.sources.readers import replace_documents, stored_chunks
from quarry.streaming.delivery import IncrementalIndex


def cut(text, size, overlap):
    out, at = [], 0
    while text:
        out.append(text[at : at + size])
        if at + size >= len(text):
            return out
        at += size - overlap
    return out


def chunks(text, size, overlap):
    packed, held = [], ""
    for part in (p.strip() for p in re.split(r"\n{2,}", text) if p.strip()):
        joined = f"{held}\n\n{part}" if held else part
        if len(joined) <= size:
            held = joined
            continue
        packed += [held] if held else []
        packed += [part] if len(part) > size else []
        held = "" if len(part) > size else part
    packed += [held] if held else []
    out = []
    for part in packed:
        end = out[-1][-overlap:] if out and overlap else None
        if end is None or part.startswith(end):
            out += cut(part, size, overlap)
        else:
            before = out[-1]
            out += [piece for piece in cut(f"{end}\n\n{part}", size, overlap) if piece != before]
    return out


def test_chunks_carry_the_end_of_the_one_before(spark):
    rng = random.Random(1)
    texts = ["", "a", "x" * 100, "aaaa\n\naaaa\n\naaaa\n\naaaa", "ab " * 40 + "\n\n" + "cd " * 5]
    for _ in range(150):
        texts.append("\n\n".join("".join(rng.choices("abc ", k=rng.choice([1, 5, 20, 60, 130]))) for _ in range(rng.randrange(1, 9))))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    for size, overlap in ((40, 10), (40, 0), (30, 50), (25, 7)):
        got = {r.id: r.c for r in df.select("id", overlapped(pack(paragraphs(F.col("text")), size), size, overlap).alias("c")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == chunks(t, size, min(overlap, size - 1)), (t, size, overlap)
            assert all(len(c) <= size for c in got[i])
    # by hand: paragraphs of 8 and 8 characters fit 20, the third takes up the last four of them
    text = "aaaaaaaa\n\nbbbbbbbb\n\ncccccccc"
    assert [r.c for r in spark.createDataFrame([(text,)], "text string").select(overlapped(pack(paragraphs(F.col("text")), 20), 20, 4).alias("c")).collect()] == [["aaaaaaaa\n\nbbbbbbbb", "bbbb\n\ncccccccc"]]


def test_hash_embedding_sums_tokens():
    def plain(text, n=384):
        v = [0.0] * n
        for token in re.findall("[a-zA-Z0-9一-鿿]+", text.lower()):
            d = hashlib.sha256(token.encode()).digest()
            for i in range(n):
                v[i] += (d[i % 32] / 255 - 0.5) * (1 + i % 7 * 0.05)
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        return [x / norm for x in v]

    for text in ("", "Net Sales rose", "收入 12%, net", "a a b"):
        assert max(abs(x - y) for x, y in zip(hash_embedding(text), plain(text))) < 2e-6
    dot = lambda a, b: sum(x * y for x, y in zip(hash_embedding(a), hash_embedding(b)))
    assert dot("net sales rose", "sales rose net") > 0.999 > dot("net sales rose", "net sales fell") > dot("net sales rose", "other words here")


def test_replaced_documents(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = lambda *r: spark.createDataFrame(list(r), "tenant_id string, doc_id string, chunk_no int")
    stored = lambda: sorted((r.tenant_id, r.doc_id, r.chunk_no) for r in stored_chunks(spark, path).collect())
    replace_documents(rows(("t", "a", 0), ("t", "a", 1), ("t", "b", 0), ("u", "a", 0)), path, buckets=1)
    replace_documents(rows(("t", "a", 5)), path, buckets=1)
    assert stored() == [("t", "a", 5), ("t", "b", 0), ("u", "a", 0)]  # others of the bucket stay
    gone = spark.createDataFrame([("t", "a"), ("u", "a")], "tenant_id string, doc_id string")
    replace_documents(rows(), path, gone, buckets=1)
    assert stored() == [("t", "b", 0)]
    replace_documents(rows(("u", "c", 1)), path, buckets=1)
    assert stored() == [("t", "b", 0), ("u", "c", 1)]


def test_index_registers_every_upload(spark, tmp_path):
    index = IncrementalIndex(str(tmp_path / "index"), embed=lambda texts: [[float(len(t))] for t in texts])
    rows = lambda *r: spark.createDataFrame(list(r), "tenant_id string, doc_id string, text string")
    index.take(rows(("t", "b", "hello"), ("t", "a", "hello"), ("t", "c", "  ")), 0)
    index.take(rows(("t", "z", "  "), ("t", "d", "new")), 1)
    uploads = spark.read.parquet(f"{index.path}/uploads").collect()
    assert sorted((r.doc_id, r.batch) for r in uploads) == [("a", 0), ("c", 0), ("d", 1)]
    assert sorted((r.doc_id, r.text, r.embedding[0], r.chunk_id) for r in index.ready(spark).collect()) == [("a", "hello", 5.0, "a:p1:c0"), ("d", "new", 3.0, "d:p1:c0")]


def test_files_of_each_supplier_are_read_once_and_share_folders(spark, tmp_path):
    from quarry.plans.source_queries import _exported
    from quarry.sources.readers import by_suffix

    spark.range(3000).selectExpr("id AS s_suppkey", "concat('Supplier#', id) AS s_name").write.parquet(f"{tmp_path}/supplier.parquet")
    folder = _exported(spark, str(tmp_path))
    inside = list(Path(folder.removeprefix("file:")).iterdir())
    assert len(inside) == 3 and sum(len(list(p.iterdir())) for p in inside) == 3000
    good, bad = by_suffix(spark, folder)
    assert (good.count(), bad.count()) == (2250, 750)
    assert all("uploads" not in f for f in [*good.inputFiles(), *bad.inputFiles()])


def test_texts_are_embedded_a_slice_at_a_time(spark):
    from quarry.functions.embedding import TEXTS, embedder

    d = spark.range(2000, numPartitions=1).selectExpr("id", "IF(id % 7 = 0, null, concat('t', id)) AS text")
    got = d.select("id", embedder(lambda texts: [[float(len(texts))] for _ in texts])("text").alias("v")).collect()
    assert all((r.v is None) == (r.id % 7 == 0) for r in got) and 0 < max(r.v[0] for r in got if r.v) <= TEXTS
