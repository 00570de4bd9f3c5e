"""Synonym closure in lexical scores, pruned ranking against whole ranking, and searches in scopes."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import retrieval as R
from quarry.operators.impacts import candidates
from quarry.operators.ranking import top_k

GROUP = {m: set(g) for g in T.SYNONYMS for m in g}


def closure(tokens):
    out = set(tokens)
    for t in tokens:
        if t in GROUP:
            out |= GROUP[t]
        elif len(t) > 1:
            out |= {x for m, g in GROUP.items() if m in t or t in m for x in g}
    return out


CASES = [["operating_margin"], ["margin"], ["salesforce", "x"], ["in", "a", "7"], ["供应"], ["毛利率", "y"], ["compar"], ["riskiest"], [], ["研发强度高"], ["zz"]]


def test_closure_and_its_short_form(spark):
    rows = spark.createDataFrame([(i, c, " ".join(c)) for i, c in enumerate(CASES)], "i int, t array<string>, text string")
    got = rows.select("t", T.expand_synonyms(F.col("t")).alias("e"), T.closed_tokens(F.col("text")).alias("c"), T.closed_terms(F.col("text")).alias("s")).collect()
    for r in got:
        assert set(r.e) == closure(r.t) and len(set(r.e)) == len(r.e)
        words = {x for x in r.s if not x.startswith("#")}
        assert words | {m for x in r.s if x.startswith("#") for m in T.SYNONYMS[int(x[1:])]} == set(r.c)
    weights = rows.select(F.explode(T.closed_terms(F.col("text"))).alias("t")).select("t", T.term_weight(F.col("t")).alias("w")).collect()
    assert all(r.w == (len(T.SYNONYMS[int(r.t[1:])]) if r.t.startswith("#") else 1) for r in weights)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="marginopet_", min_size=1, max_size=12))
def test_parts_are_what_lies_in_members(token):
    touched = {g for g, group in enumerate(T.SYNONYMS) if token in group} or {g for g, group in enumerate(T.SYNONYMS) if len(token) > 1 and any(token in m or m in token for m in group)}
    near = {g for g, group in enumerate(T.SYNONYMS) if token in group or token in T.PARTS[g] or (token not in GROUP and any(m in token for m in group))}
    assert near == touched


def test_lexical_search_equals_all_scores(spark):
    chunks = [(i, " ".join(["sales", "of", "tin", "cups", "营收", "risk", f"w{i % 7}", f"v{i}"][: i % 8 + 1])) for i in range(200)] + [(500, None), (501, "")]
    queries = [(1, "revenue risk w3"), (2, "tin in w5"), (3, "nothing v17"), (4, ""), (5, None)]
    c, q = spark.createDataFrame(chunks, "chunk_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    want = top_k(R.lexical_scores(q, c), 5, tie="chunk_id").withColumnRenamed("top_rank", "rank").select("query_id", "rank", "chunk_id", "score").collect()
    for direct in (0, 10**9):
        got = R.lexical_search(q, c, 5, direct=direct).select("query_id", "rank", "chunk_id", "score").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    words = lambda t: closure(re.findall("[a-z0-9]{2,}|[0-9]", t or "") + [x for x in (t or "").split() if ord(x[0]) > 255])
    text, asked = dict(chunks), dict(queries)
    for r in want:
        plain = len(words(asked[r.query_id]) & words(text[r.chunk_id])) / len(words(asked[r.query_id]))
        assert round(plain, 4) <= r.score <= round(min(1, plain + 0.15), 4)


@pytest.mark.parametrize("most", [None, 1.5])
def test_pruned_ranking_is_the_whole_ranking(spark, most):
    r = np.random.default_rng(5)
    post = [(0, f"t{t}", int(d), float(np.round(r.gamma(2.0, 0.3) + 0.01 + t % 3, 3))) for t in range(30) for d in r.choice(3000, size=int(3000 / (t + 1)), replace=False)]
    terms = [(q, 0, f"t{t}", float(r.integers(1, 4))) for q in range(25) for t in r.choice(35, size=r.integers(1, 9), replace=False)]
    p, t = spark.createDataFrame(post, "scope long, term string, key long, impact double"), spark.createDataFrame(terms, "query_id long, scope long, term string, weight double")
    cut = lambda c: F.round(c if most is None else F.least(c, F.lit(most)), 4)
    best = lambda d: sorted(map(tuple, top_k(d.select("query_id", "key", cut(F.col("score")).alias("score")), 6, tie="key").collect()))
    if most is None:
        assert best(candidates(t, p, 6, direct=0)) == best(candidates(t, p, 6, direct=10**9))
    else:  # cut scores tie: every document that reaches the cut must stay
        assert best(candidates(t, p, 6, most=most, direct=0)) == best(candidates(t, p, 6, direct=10**9))


def test_frequent_terms_are_not_scored(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the common words here "), F.concat_ws(" ", F.concat(F.lit("w"), (F.col("id") % 997).cast("string")), F.concat(F.lit("v"), (F.col("id") % 89).cast("string")))).alias("text"))
    queries = spark.createDataFrame([(i, f"the common words w{i * 7} v{i}") for i in range(40)], "query_id long, text string")
    seen = {}
    got = R.bm25(queries, docs, 10, direct=0, counted=seen).select("query_id", "rank", "doc_id", "score").collect()
    want = R.bm25(queries, docs, 10, direct=10**12).select("query_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert seen["met"] < seen["all"] / 10, seen


def test_scopes_come_before_ranks(spark):
    docs = spark.createDataFrame([(i, f"apple {'pear ' * (i % 5)} d{i}") for i in range(60)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "pear"), (2, "pear"), (3, "pear")], "query_id long, text string")
    own = spark.createDataFrame([(i, f"c{i % 3}") for i in range(60)] + [(i, "extra") for i in range(10)], "doc_id long, scope string")
    asked = spark.createDataFrame([(1, "c0"), (1, "extra"), (2, "c1")], "query_id long, scope string")
    member = {1: {i for i in range(60) if i % 3 == 0 or i < 10}, 2: {i for i in range(60) if i % 3 == 1}}
    whole = R.bm25(q, docs, 60).collect()
    for direct in (0, 10**9):
        got = R.bm25(q, docs, 4, scopes=(asked, own), direct=direct).collect()
        for query, ids in member.items():
            want = sorted(((-r.score, r.doc_id) for r in whole if r.query_id == query and r.doc_id in ids))[:4]
            assert [(-r.score, r.doc_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == query] == want
        assert {r.query_id for r in got} == {1, 2}
    local = R.bm25(q.where("query_id = 2"), docs, 4, scopes=(asked, own), own_statistics=True).collect()
    alone = R.bm25(q.where("query_id = 2"), docs.where("doc_id % 3 = 1"), 4).collect()
    assert sorted(map(tuple, local)) == sorted(map(tuple, alone))


def test_dense_in_scope_is_the_ranking_of_the_scope(spark):
    r = np.random.default_rng(1)
    v = [(i, r.normal(size=4).tolist()) for i in range(80)]
    vectors, q = spark.createDataFrame(v, "vec_id long, embedding array<double>"), spark.createDataFrame(v[:3], "query_id long, embedding array<double>")
    own = spark.createDataFrame([(i, f"c{i % 3}") for i in range(80)] + [(i, "c9") for i in range(80)], "vec_id long, scope string")
    asked = spark.createDataFrame([(0, "c0"), (1, "c1"), (1, "c9")], "query_id long, scope string")
    got = R.cosine_top_k(q, vectors.repartition(3), 5, scopes=(asked, own), block=16).collect()
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x in v}
    for query, ids in ((0, range(0, 80, 3)), (1, range(80))):
        want = sorted((-round(float(unit[query] @ unit[i]), 4), i) for i in ids)[:5]
        assert [(-x.score, x.vec_id) for x in sorted(got, key=lambda x: x["rank"]) if x.query_id == query] == want
    assert {x.query_id for x in got} == {0, 1}


def test_a_query_that_stands_in_a_paragraph(spark):
    docs = spark.createDataFrame([(1, "first one\n\nthe quick brown fox jumps\nover it"), (2, "brown quick fox the jumps over"), (3, "quick\n\n  the quick  brown")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "  quick brown fox "), (2, "quick  b"), (3, "absent words"), (4, "uick")], "query_id long, text string")
    got = {(r.query_id, r.doc_id, r.paragraph): r.score for r in R.paragraph_search(q, docs).collect()}
    assert got[1, 1, 1] == 1.0 and got[1, 2, 0] == 1.0 and got[1, 3, 1] < 1 and got[2, 3, 1] == 1.0 and got[4, 3, 0] == 1.0
    assert not any(k[0] == 3 for k in got)


def test_metrics_that_are_asked_for(spark):
    q = spark.createDataFrame([(1, "net sales and free cash flow"), (2, "long term x"), (3, "")], "query_id long, query_text string")
    metrics = spark.createDataFrame([("revenue",), ("free_cash",), ("x",), ("debt",), ("term_x",)], "metric string")
    got = {(r.query_id, r.metric) for r in R.asked_metrics(q, metrics).collect()}
    assert got == {(1, "revenue"), (1, "free_cash"), (2, "x"), (2, "term_x")}


def test_alias_stands_for_the_row_label(spark):
    q = spark.createDataFrame([(1, "revenue zz")], "query_id long, text string")
    rows = [(i, "zz", ("revenue", "", "", label, "", alias)) for i, (label, alias) in enumerate([("", "Total revenue"), (None, "total"), ("sales", "total"), (None, None)])]
    c = spark.createDataFrame(rows, f"chunk_id long, text string, fact {R.FACT}")
    got = {r.chunk_id: r.score for r in R.keyword_scores(q, c).collect()}
    assert got[0] == got[1] == 1.0 and got[2] == got[3] == 0.95


def test_searches_in_tasks_are_the_whole_rankings(spark):
    """Without pruning arguments neither texts nor postings are shuffled; ties, copies and scopes as before."""
    rng = random.Random(8)
    vocabulary = ["revenue", "sales", "margin", "risk", "supply", "chain", "ntion", "a", "7", "_x", "the", "income", "in", "供应链风险"] + [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 30))) for _ in range(3000)]
    texts[500:900] = texts[:400]
    texts[1000:1400] = [texts[0]] * 400
    d = spark.createDataFrame([(i, t or None) for i, t in enumerate(texts)], "doc_id long, text string")
    q = spark.createDataFrame([(i, " ".join(rng.choices(vocabulary, k=6))) for i in range(40)] + [(40, ""), (41, None), (42, texts[0])], "query_id long, text string")
    rows = lambda df, key: sorted((r.query_id, r["rank"], r[key], r.score) for r in df.collect())
    assert rows(R.bm25(q, d, 7), "doc_id") == rows(R.bm25(q, d, 7, direct=10**12), "doc_id")
    c = d.selectExpr("concat('c', doc_id) AS chunk_id", "text")
    found = R.lexical_search(q, c, 7)
    assert rows(found, "chunk_id") == rows(R.lexical_search(q, c, 7, direct=10**12), "chunk_id")
    asked = q.selectExpr("query_id", "query_id % 5 AS scope").union(q.selectExpr("query_id", "query_id % 3 AS scope"))
    own = d.selectExpr("doc_id", "doc_id % 4 AS scope").where("doc_id % 7 > 0")
    assert rows(R.bm25(q, d, 7, scopes=(asked, own)), "doc_id") == rows(R.bm25(q, d, 7, scopes=(asked, own), direct=10**12), "doc_id")
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "SortMergeJoin" not in plan
    twice = d.where("doc_id < 50").union(d.where("doc_id < 25"))
    assert rows(R.bm25(q, twice, 7), "doc_id") == rows(R.bm25(q, twice, 7, direct=10**12), "doc_id")


def test_only_texts_of_hits_leave_their_tasks(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(9)], "doc_id long, text string")
    found = R.documents_of(docs.where("doc_id < 2").union(docs.where("doc_id < 3")), docs)
    assert {r.text for r in found.collect()} == {"t0", "t1", "t2"} and found.count() == 3
    assert "BroadcastHashJoin" in found._jdf.queryExecution().toString()
