from quarry.operators.payload import company_payloads

DOCS = "doc_id long, doc_pos long, companies array<string>, text string, excerpt string, citation string"
AMOUNTS = "doc_id long, company string, amount_no long, metric string, normalized_value double, unit string, currency string, confidence string, period string, period_type string, period_end string, source string, provider string, is_normalized boolean, citation string, record_id string"


def amount(doc, company, no, metric, value, **more):
    row = dict(doc_id=doc, company=company, amount_no=no, metric=metric, normalized_value=value, unit="billion_usd", currency="USD", confidence="high", period=None, period_type=None, period_end=None, source="inline_unit", provider=None, is_normalized=None, citation=None, record_id=None)
    row |= more
    return tuple(row.values())


def payloads(spark, docs, amounts):
    found = company_payloads(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(amounts, AMOUNTS).repartition(3))
    return {name: df.collect() for name, df in found.items()}


def test_the_last_trusted_amount_wins_and_the_rest_is_seen(spark):
    docs = [
        (1, 2, ["Apple"], "Supplier concentration grows.", "x" * 700, "later.pdf"),
        (2, 1, ["Apple", "Oracle", "Apple", " "], "nothing", "", "first.pdf"),
        (3, 0, None, "foundry", "none of them", None),
        (4, 9, ["Intel"], None, None, None),
    ]
    got = payloads(spark, docs, [
        amount(1, "Apple", 0, "revenue", 5.0, period="TTM", period_type="x"), amount(2, "Apple", 9, "revenue", 7.0),
        amount(1, "Apple", 1, "revenue", 900.0), amount(1, "Apple", 2, "gross_margin", 0.4), amount(1, "Apple", 3, "ebitda", 1.0, period_type="quarter"),
        amount(2, "Apple", 1, "ebitda_2024", 2.0, source="provider_metadata", provider="p", period="FY2024", is_normalized=True, record_id="r", citation="own"),
        amount(2, None, 1, "r_and_d", 3.0), amount(1, None, 1, "r_and_d", 4.0), amount(2, "Oracle", 1, "operating_income", 6.0, source=None),
        amount(4, None, 1, "r_and_d", 8.0), amount(4, None, 2, "ebitda", 8.0, source="provider_metadata", provider=" ", period="FY2024", is_normalized=True), amount(3, "Apple", 1, "revenue", 1.0), amount(77, "Apple", 1, "revenue", 1.0),
    ])
    facts = {(r.company, r.metric): r for r in got["fundamentals"]}
    assert {k: r.value for k, r in facts.items()} == {("Apple", "revenue"): 5.0, ("Apple", "ebitda_2024"): 2.0, ("Intel", "r_and_d"): 8.0}
    last, provided = facts["Apple", "revenue"].provenance, facts["Apple", "ebitda_2024"].provenance
    assert (last.source, last.period, last.period_type, last.citation, last.source_record_id) == ("document_extracted", None, "ttm", "later.pdf", "document:1:revenue")
    assert (provided.source, provided.period, provided.period_type, provided.citation, provided.source_record_id) == ("provider_metadata", "FY2024", None, "own", "r")
    seen = {(r.company, r.metric): (r.value, r.refused) for r in got["observations"]}
    assert seen == {
        ("Apple", "revenue"): (900.0, "implausible"), ("Apple", "gross_margin"): (0.4, "not_fundamental"), ("Apple", "ebitda"): (1.0, "untrusted"), ("Apple", "ebitda_2024"): (2.0, None),
        ("Oracle", "operating_income"): (6.0, "legacy_unverified"), ("Intel", "r_and_d"): (8.0, None), ("Intel", "ebitda"): (8.0, "untrusted"),
    }
    assert [(r.company, r.doc_id, len(r.quote)) for r in got["quotes"]] == [("Apple", 1, 500)]
    assert {r.company: tuple(r[1:]) for r in got["companies"]} == {"Apple": (2, 1, "medium", 1, "document_extracted"), "Oracle": (1, 0, "unknown", 0, "none"), "Intel": (1, 0, "unknown", 0, "document_extracted")}


def test_nothing(spark):
    assert all(not rows for rows in payloads(spark, [], []).values())
    alone = payloads(spark, [(1, 1, ["Apple"], None, None, None)], [])
    assert [tuple(r) for r in alone["companies"]] == [("Apple", 1, 0, "unknown", 0, "none")] and not alone["fundamentals"]


def test_one_company_with_very_many_documents(spark):
    from pyspark.sql import functions as F

    n = 20_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.col("id").alias("doc_pos"), F.array(F.lit("Apple")).alias("companies"), F.lit("t").alias("text"), F.lit("e").alias("excerpt"), F.lit(None).cast("string").alias("citation"))
    some = spark.createDataFrame([amount(0, "Apple", 1, "revenue", 0.5)], AMOUNTS)
    amounts = spark.range(n).crossJoin(some).withColumns({"doc_id": F.col("id"), "normalized_value": F.col("id") / 100.0}).drop("id")
    got = company_payloads(docs, amounts)
    assert [(r.value, r.doc_id) for r in got["fundamentals"].collect()] == [((n - 1) / 100.0, n - 1)] and got["quotes"].count() == n
