import pytest
from pyspark.sql import functions as F

from quarry.operators.number_spans import alias_distance, match_formulas, match_numbers, number_spans

CASES = [  # value, unit, metric, claim period, text, its own period; reason, value, conversion, confidence
    (29.5, "billion_usd", "revenue", "FY2024", "In FY2024 revenue was $29.5 billion.", None, "bound", 29.5, None, "high"),
    (29.5, "billion_usd", "revenue", "FY2024", "FY2024 (in millions) net sales 29,510", None, "bound", 29.51, "million_to_billion", "high"),
    (29.5, "billion_usd", "revenue", "FY2024", "FY2024 net sales 29,510", None, "number_not_found", None, None, "none"),
    (29.5, "billion_usd", "revenue", "FY2024", "FY2024 sales of 29,500,000,000", None, "bound", 29.5, "raw_usd_to_billion", "high"),
    (29.5, "billion_usd", "revenue", "FY2024", "FY2024 revenue was $129.55 billion.", None, "number_not_found", None, None, "none"),
    (29.5, "billion_usd", "revenue", "FY2024", "FY2024 revenue was 29.5 in all", None, "unit_ambiguous", 29.5, None, "low"),
    (29.5, "billion_usd", "debt", "FY2024", "FY2024 revenue was $29.5 billion.", None, "metric_label_mismatch", 29.5, None, "none"),
    (29.5, "billion_usd", "revenue", "FY2024", "FY2023 revenue was $29.5 billion.", None, "period_mismatch", 29.5, None, "none"),
    (29.5, "billion_usd", "revenue", "FY2024", "Revenue was $29.5 billion.", None, "period_unknown", 29.5, None, "none"),
    (29.5, "billion_usd", "revenue", "FY2024", "Revenue was $29.5 billion.", "FY2024", "bound", 29.5, None, "high"),
    (29.5, "billion_usd", "revenue", "FY2024", "FY2024 revenue was $29.5 billion.", "FY2023", "period_metadata_conflict", 29.5, None, "none"),
    (29.5, "billion_usd", "revenue", None, "Debt of $29.5 billion; revenue of $29.5 billion", None, "bound", 29.5, None, "high"),
    (0.348, "ratio", "gross_margin", "FY2024", "FY2024 gross margin was 34.7 %", None, "bound", 0.347, None, "medium"),
    (0.348, "ratio", "gross_margin", "FY2024", "FY2024 gross margin was 39.0%", None, "number_not_found", None, None, "none"),
    (5.0, "billion_usd", "revenue", "FY2024", "FY2024 revenue 5 of 5", None, "number_not_found", None, None, "none"),
    (float("nan"), None, "revenue", "FY2024", "FY2024 revenue 55", None, "number_not_found", None, None, "none"),
    (None, None, None, None, None, None, "number_not_found", None, None, "none"),
    (29.5, "billion_usd", "free_cash", "FY2024", "free cash of FY2024: $29.5 billion", None, "bound", 29.5, None, "high"),
]


def test_every_reason(spark):
    claims = spark.createDataFrame([(i, f"c{i}", c[2], c[0], c[1], c[3]) for i, c in enumerate(CASES)], "claim_id long, company string, metric string, value double, unit string, period string")
    texts = spark.createDataFrame([(f"e{i}", f"c{i}", c[4], c[5]) for i, c in enumerate(CASES)], "evidence_id string, company string, text string, period string")
    got = {int(r.claim_id): r for r in match_numbers(claims, texts).collect()}
    for i, (*_, reason, value, conversion, sure) in enumerate(CASES):
        r = got[i]
        assert (r.reason, r.matched, r.unit_conversion, r.confidence) == (reason, reason == "bound", conversion, sure), (i, r)
        assert (r.matched_value is None) == (value is None) and (value is None or r.matched_value == pytest.approx(value)), (i, r)
        assert (r.evidence_id is None) == (reason == "number_not_found")
    assert got[11].start == CASES[11][4].rindex("29.5")


def test_spans_and_distances(spark):
    text = "Cash was 1,234.50, up 3% in FY2020 to 12.5.\nvalue -7 x2.5y 1.2.3"
    rows = number_spans(spark.createDataFrame([("a", text), ("b", None), ("c", "")], "evidence_id string, text string")).collect()
    assert [(r.value, r.decimals, r.digits, r.percent) for r in rows][:3] == [(1234.5, 2, 6, False), (3.0, 0, 1, True), (2020.0, 0, 4, False)]
    assert all(text[r.start :].replace(",", "").startswith((f"{r.value:g}", f"{r.value:.2f}")) for r in rows)
    around = ["revenue x 5 y sales", "5 sales", "no label 5", "netsales5"]
    df = spark.createDataFrame([(s, s.index("5") + 1) for s in around], "around string, at int")
    got = [r.d for r in df.select(alias_distance(F.col("around"), F.col("at"), F.lit("revenue")).alias("d")).collect()]
    assert got == [4, 2, None, 5]


def test_formulas(spark):
    claims = spark.createDataFrame(
        [(1, "c", {"revenue": 60.5, "debt": 20.5}, "FY2001"), (2, "c", {"revenue": 60.5, "debt": None}, "FY2001"), (3, "c", {}, "FY2001"), (4, "c", None, "FY2001"), (5, "d", {"revenue": 60.5}, "FY2001"), (6, "c", {"revenue": 60.5}, "FY2002")],
        "claim_id long, company string, inputs map<string,double>, period string",
    )
    texts = spark.createDataFrame([("both", "c", "FY2001 revenue: $60.5 billion. FY2001 debt: $20.5 billion.", None), ("one", "c", "FY2001 revenue: $60.5 billion.", None)], "evidence_id string, company string, text string, period string")
    got = {(r.claim_id, r.evidence_id): r.reason for r in match_formulas(claims, texts).collect()}
    assert got[("1", "both")] == "formula_inputs_bound" and got[("1", "one")] == "formula_input_incomplete"
    assert {v for k, v in got.items() if k[0] in "2345"} == {"formula_input_incomplete"}
    assert got[("6", "one")] == "formula_input_period_mismatch"


def test_periods_of_distinct_cases_and_sentences(spark, monkeypatch):
    """Each sentence of a text is searched for labels once, and each distinct case of periods judged once."""
    from quarry.operators import number_spans as N
    from quarry.operators import periods as P

    searched, pattern = [], P._LABEL

    class Counting:
        def finditer(self, text):
            searched.append(text)
            return pattern.finditer(text)

    monkeypatch.setattr(P, "_LABEL", Counting())
    text = "In FY2001 it was " + ", ".join(str(1000 + i) for i in range(200)) + ". Then FY2002: 5.5 after FY2003"
    near = P.labels_around(text)
    assert [near(m.start(), m.end()) for m in N.NUMBER.finditer(text)].count(["FY2001"]) > 200 and len(searched) == 2
    monkeypatch.undo()
    calls, judge = [], P.match_near
    monkeypatch.setattr(P, "match_near", lambda *a: calls.append(a) or judge(*a))
    claims = spark.createDataFrame([(i, f"c{i}", "revenue", 29.5, "billion_usd", "FY2024" if i % 2 else None) for i in range(40)], "claim_id long, company string, metric string, value double, unit string, period string")
    texts = spark.createDataFrame([(f"e{i}", f"c{i}", f"FY202{4 - i % 4 // 2} revenue was $29.5 billion.", None) for i in range(40)], "evidence_id string, company string, text string, period string")
    got = {int(r.claim_id): r.reason for r in match_numbers(claims, texts).collect()}
    assert got == {i: "bound" if i % 4 == 1 else "period_mismatch" for i in range(40)} and len(calls) == 1
    monkeypatch.setattr(N, "FEW_PERIODS", 0)
    assert {int(r.claim_id): r.reason for r in match_numbers(claims, texts).collect()} == got


def test_targets_take_the_classes_within_their_slack(spark):
    from quarry.operators.number_spans import _size_class, targets

    values = [0.01, 1.0, 1.49, 1.5, 2.25, 12.3, 29.5, 3377.0, 1e300]
    rows = targets(spark.createDataFrame([(v * sign, "billion_usd") for v in values for sign in (1, -1)], "value double, unit string"))
    ends = rows.groupBy("value", "form", "target", "slack").agg(F.collect_set("bucket").alias("b"), F.count("*").alias("n"))
    reach = F.when(F.col("form") == "printed", F.lit(0.5)).otherwise(F.col("slack"))
    for r in ends.select("*", F.array(*(_size_class(F.col("target") + d * reach) for d in (-1, 0, 1))).alias("want")).collect():
        assert set(r.want) <= set(r.b) and len(r.b) == r.n <= 3, r
    assert rows.count() < 9 * 2 * len(values) * 0.6
