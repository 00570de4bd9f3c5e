from quarry.operators.document_chunks import document_chunks

PEERS = "Peers\nMetric  Apple  Oracle\nunits  1,200  34.5\nstores  7  8"
SALES = "Oracle's supply chain risk remains. Apple said: total net sales were $2,500 million in FY2024.\n\nNet sales of the Americas segment: $900 million."


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, table_no int, metric string, period string, value double, scope string")


def chunks(spark, pages, tables=None, **more):
    df = spark.createDataFrame(pages, "doc_id long, page long, text string, issuers array<string>, mentioned array<string>").repartition(3)
    rows = document_chunks(df, tables, **more).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for d in by.values():
        d.sort(key=lambda r: r.position)
        assert [r.position for r in d] == list(range(len(d)))
        assert len({r.chunk_id for r in d}) == len(d) and all(r.char_count == len(r.text) for r in d)
    return by


def test_all_kinds_in_order(spark):
    both = ["Apple", "Oracle"]
    by = chunks(spark, [(1, 1, PEERS, both, None), (1, 2, SALES, both, None), (1, 3, None, both, None), (2, 1, "plain words", [], ["Oracle"]), (3, 1, "", None, None)], table(spark, [(1, 0, "revenue", "FY2024", 9.0, "segment"), (1, 1, "revenue", "FY2023", 2400.0, "consolidated")]))
    one = by[1]
    assert [(r.kind, r.page, r.text, r.companies) for r in one[:4]] == [
        ("peer_row", 1, "Apple units: 1200 (peer table).", ["Apple"]), ("peer_row", 1, "Oracle units: 34.5 (peer table).", ["Oracle"]),
        ("peer_row", 1, "Apple stores: 7 (peer table).", ["Apple"]), ("peer_row", 1, "Oracle stores: 8 (peer table).", ["Oracle"]),
    ]
    assert one[4].kind == "text" and one[4].page == 2 and one[4].companies == both and one[4].chunk_id == "1:p2:c0"
    facts = [r for r in one if r.kind == "text_fact"]
    best = facts[0]
    assert best.fact.metric == "revenue" and best.fact.value == "2500" and best.companies == ["Apple"] and best.chunk_type == "financial_metric"
    assert best.text == f"Apple revenue FY2024: 2500 million (filing fact; {best.fact.scope}; {best.fact.statement})." and best.chunk_id.startswith("1:p2:f")
    assert [(r.kind, r.fact.period, r.fact.value, r.position) for r in one if r.kind == "table_fact"] == [("table_fact", "FY2023", "2400", len(one) - 1)]
    assert [(r.kind, r.companies) for r in by[2]] == [("text", ["Oracle"])] and 3 not in by


def test_a_table_outranks_the_last_fact(spark):
    pages = [(1, 1, "Total net sales were $2,500 million in FY2024.", ["Apple"], None), (1, 2, "Total net sales were $2,600 million in FY2024.", ["Apple"], None)]
    kept = chunks(spark, pages)[1]
    assert [(r.page, r.fact.value) for r in kept if r.kind == "text_fact"] == [(1, "2500"), (2, "2600")]
    scope = kept[-1].fact.scope
    for value, table_scope, want in ((10.0, "narrative", [(1, "2500"), (2, "2600")]), (9999.0, "consolidated", None)):
        got = chunks(spark, pages, table(spark, [(1, 0, "revenue", "FY2024", value, table_scope), (1, 1, "revenue", "FY2024", value, table_scope)]))[1]
        facts = [(r.page, r.fact.value) for r in got if r.fact]
        if want is None and scope != "consolidated":
            want = [(1, "2500"), (2, "9999")]  # the table's fact stands for that of page 2
        assert facts == (want or [(1, "2500"), (2, "2600")])


def test_long_pages_and_many_pages(spark):
    pages = [(7, i, f"part {i} " + "word " * 300, ["Apple"], None) for i in range(1, 60)]
    got = chunks(spark, pages, size=400, overlap=40)[7]
    assert {r.page for r in got} == set(range(1, 60)) and all(r.char_count <= 400 and r.companies == ["Apple"] for r in got)
    assert [r.page for r in got] == sorted(r.page for r in got)
