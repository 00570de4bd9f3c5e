"""Golden rows, by hand, of periods, facts, issuers, notes, tickers and claims."""

from pyspark.sql import functions as F

from quarry.operators import claim_building as B
from quarry.operators import periods as P
from quarry.operators.entities import resolve_tickers
from quarry.operators.fact_text import document_issuers, financial_facts, research_notes
from quarry.operators.ranking import numbered
from quarry.operators.retrieval import bm25, containing, retrieve


def test_period_identities(spark):
    labels = {"2024-05-01": ("date", 2024, 2), "Q3 2023": ("quarter", 2023, 3), "2023 Q1": ("quarter", 2023, 1), "FY 2022": ("fiscal_year", 2022, None), "fiscal year 2021": ("fiscal_year", 2021, None), "2020": ("calendar_year", 2020, None), "annual": ("unknown", None, None), "": ("unknown", None, None), "in 2019 or so": ("unknown", 2019, None), "Q2 of 2024": ("quarter", 2024, 2)}
    rows = spark.createDataFrame([(k,) for k in labels], "label string").select("label", P.identity(F.col("label")).alias("i")).collect()
    assert {r.label: (r.i.kind, r.i.year, r.i.quarter) for r in rows} == labels


def test_periods_near_a_number(spark):
    text = "In FY2023 it fell. Revenue was 12.5 in FY2024, or 11 in FY2022; more"
    rows = spark.createDataFrame([(1, text, text.index("12.5"), text.index("12.5") + 4), (2, None, 0, 0), (3, "FY2024 7 FY2023", 7, 8)], "id long, text string, first int, last int")
    got = {r.id: r.labels for r in P.nearest_labels(rows).collect()}
    assert got == {1: ["FY2024"], 2: [], 3: ["FY2024", "FY2023"]}


def test_facts_of_a_page(spark):
    page = "Consolidated statements of operations. Total net sales were $391,035 million in fiscal 2024; net sales of services $96.2 billion. R&D was $31 billion. Revenue: 12."
    got = {(r.metric, r.label): (r.value, r.unit, r.period, r.scope, r.company) for r in financial_facts(spark.createDataFrame([(1, 1, page, ["Apple"]), (2, 1, None, None)], "doc_id long, page long, text string, issuers array<string>")).collect()}
    assert got[("revenue", "total net sales")] == ("391035", "million", "FY2024", "consolidated", "Apple")
    assert got[("r_and_d", "r&d")] == ("31", "billion", "FY2024", "consolidated", "Apple")
    assert ("revenue", "revenue") not in got and ("debt", "total debt") not in got  # 12 is no company's revenue


def test_issuers(spark):
    hints = [("aapl", "Apple"), ("apple", "Apple"), ("msft", "Microsoft"), ("microsoft", "Microsoft")]
    docs = [
        (1, "10k_aapl-2024.pdf", ["Microsoft is a rival"]),
        (2, "scan.pdf", ["Annual report on Form 10-K for the year, of Microsoft Corporation and others. apple"]),
        (3, "scan.pdf", ["Metric Apple Microsoft\nrevenue 1 2"]),
        (4, "scan.pdf", ["nothing here"]),
        (5, None, None),
        (6, "myapplefile.txt", [""]),
    ]
    got = {r.doc_id: (r.primary, r.method, r.issuers) for r in document_issuers(spark.createDataFrame(docs, "doc_id long, filename string, pages array<string>"), hints).collect()}
    assert got == {
        1: ("Apple", "filename", ["Apple"]),
        2: ("Microsoft", "form_10k_header", ["Microsoft"]),
        3: ("Apple", "peer_table_header", ["Apple", "Microsoft"]),
        4: (None, "none", []),
        5: (None, "none", []),
        6: ("Apple", "filename", ["Apple"]),
    }


def test_notes(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.md").write_text("\n# Title one\nbody")
    (tmp_path / "two.txt").write_text("first line\nrest")
    (tmp_path / "three.txt").write_text("  ")
    (tmp_path / "four.pdf").write_text("x")
    assert sorted(r.title for r in research_notes(spark, str(tmp_path)).collect()) == ["Title one", "first line"]


def test_titles_match_by_whole_words_inside(spark):
    directory = spark.createDataFrame([("AAA", "the acme group"), ("BBB", "globex acmes"), ("CCC", "initech co"), ("DDD", "old initech")], "ticker string, normalized string")
    curated = spark.createDataFrame([], "name string, ticker string")
    companies = spark.createDataFrame([("Acme",), ("Initech",), ("co",)], "company string")
    assert {(r.company, r.ticker) for r in resolve_tickers(companies, curated, directory).collect()} == {("Acme", "AAA"), ("Initech", None), ("co", None)}


def test_many_aliases_give_the_same_mentions(spark, monkeypatch):
    from quarry.operators import entities

    texts = spark.createDataFrame([(1, "The Acme Group and 苹果公司 met"), (2, "acmegroup; acme group, ibm"), (3, None), (4, "ibmx")], "doc_id long, text string")
    aliases = spark.createDataFrame([("acme group", "Acme"), ("苹果", "Apple"), ("ibm", "IBM"), ("ibmx corp", "X")], "alias string, company string")
    few = sorted(map(tuple, entities.mentions(texts, aliases).collect()))
    monkeypatch.setattr(entities, "FEW_ALIASES", 0)
    assert sorted(map(tuple, entities.mentions(texts, aliases).collect())) == few == [(1, "Acme"), (1, "Apple"), (2, "Acme"), (2, "IBM")]


def test_containment_of_short_passages(spark):
    texts = spark.createDataFrame([(1, "one two three four five six seven"), (2, "xone twox"), (3, "a b"), (4, "ne two three f"), (5, "")], "doc_id long, body string")
    passages = spark.createDataFrame([(1, "one two three four five six"), (2, "ne two"), (3, "two three four"), (4, "b"), (5, "e two three f")], "query_id long, passage string")
    got = {(r.query_id, r.doc_id) for r in containing(passages, texts).collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (2, 4), (3, 1), (4, 3), (5, 1), (5, 4)}


def test_numbered_and_bm25_of_nothing(spark):
    rows = spark.range(1000).repartition(7).select((F.col("id") * 37 % 1000).alias("k"))
    assert all(r.k == r.position for r in numbered(rows, "k").collect())
    assert numbered(rows.limit(0), "k").count() == 0
    q = spark.createDataFrame([(1, "cat"), (2, None)], "query_id long, text string")
    assert bm25(q, spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [(r.doc_id, r["rank"]) for r in bm25(q, spark.createDataFrame([(7, "a cat sat"), (8, None), (8, "dog")], "doc_id long, text string")).collect()] == [(7, 1)]


def test_modes_in_scope(spark):
    q = spark.createDataFrame([(1, "cat", [1.0, 0.0])], "query_id long, text string, embedding array<double>")
    d = spark.createDataFrame([(1, "cat cat"), (2, "cat and dog"), (3, "bird")], "doc_id long, text string")
    v = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0])], "doc_id long, embedding array<double>")
    own = spark.createDataFrame([(1, 2), (1, 3)], "query_id long, doc_id long")
    best = lambda rows: {r.mode: r.doc_id for r in rows.where("rank = 1").collect()}
    assert best(retrieve(("bm25", "dense", "hybrid"), q, d, v, 2)) == {"bm25": 1, "dense": 3, "hybrid": 2}  # second in both
    assert best(retrieve(("bm25", "dense", "hybrid_rerank"), q, d, v, 2, in_scope=own)) == {"bm25": 2, "dense": 3, "hybrid_rerank": 2}


def test_claims_come_back_from_their_nested_form(spark):
    rows = [("c1", "A", "numeric", "revenue", 1.5, None, "billion_usd", "FY2024", "verified", "bound", ["e1"]), ("c2", "A", "risk_conclusion", "supply_chain_risk", None, "high", None, None, "rejected", "no|evidence", [])]
    claims = spark.createDataFrame(rows, B.CLAIM)
    assert sorted(map(tuple, B.unnested(B.nested(claims)).collect())) == sorted(rows)
    assert [tuple(r) for r in B.ledger(claims).collect()] == [("A", "numeric", "A revenue is 1.50", "e1")]
    assert B.unnested(spark.createDataFrame([("A", "no json")], "entity string, claims string")).count() == 0
