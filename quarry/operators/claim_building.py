"""Claims of all types from a run's tables, the thesis on top of them, and their exported forms.

A claim is verified only if evidence binds it; where a company's fundamentals are missing its numeric
claims are withheld and the gap itself becomes a risk. Every claim that isn't verified says why.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import number_matches, numbers

ABSOLUTE = ("revenue", "ebitda", "operating_income", "r_and_d")
DIMENSIONS = ("financial_risk", "market_risk", "operational_risk")
NO_LEVEL = ("unknown", "n/a", "none")
TOLERANCE = 1e-4
CLAIM = "claim_id string, entity string, claim_type string, metric_name string, value double, label string, unit string, period string, verification string, reason string, evidence_ids array<string>"


def _none() -> Column:
    return F.array().cast("array<string>")


def blocked(companies: DataFrame) -> Column:
    return companies["fatal_gap"] | (companies["structured_source"] == "none") | ~companies["computable"]


def _claim(rows: DataFrame, kind: str, name: Column, metric: Column, good: Column, yes: str, no: Column, evidence: Column, value: Column, label: Column, unit: str | None, period: Column) -> DataFrame:
    good = F.coalesce(good, F.lit(False))
    return rows.select(
        F.concat(F.lit("cl_"), name).alias("claim_id"),
        F.col("company").alias("entity"),
        F.lit(kind).alias("claim_type"),
        metric.alias("metric_name"),
        value.cast("double").alias("value"),
        label.cast("string").alias("label"),
        F.lit(unit).cast("string").alias("unit"),
        period.cast("string").alias("period"),
        F.when(good, "verified").otherwise("rejected").alias("verification"),
        F.when(good, yes).otherwise(no).alias("reason"),
        F.when(good, evidence).otherwise(_none()).alias("evidence_ids"),
    )


def bound_fields(fundamentals: DataFrame, evidence: DataFrame) -> DataFrame:
    """(company, metric, evidence_id): fundamentals that a field of the evidence states, the first one."""
    fields = evidence.where("kind = 'field'").select("company", "metric", "evidence_id", F.col("value").alias("stated"))
    near = F.abs(F.col("value") - F.col("stated")) <= TOLERANCE * F.abs(F.col("stated"))
    return fundamentals.hint("merge").join(fields, ["company", "metric"]).where(near).groupBy("company", "metric").agg(F.min("evidence_id").alias("evidence_id"))


def build_claims(companies: DataFrame, fundamentals: DataFrame, ratios: DataFrame, snapshots: DataFrame, scores: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims (CLAIM) of companies (company, period, fatal_gap, structured_source, computable,
    risk_level) from fundamentals (company, metric, value, prior), ratios (company, metric, value,
    inputs), snapshots (company, trailing_pe), scores (company, dimension, score) and evidence (company,
    evidence_id, kind, metric, value, text) with kinds field, market, supply, risk and page. A null in
    any of these is no value. Tables that lack a company say nothing about it."""
    companies = companies.select("company", "period", blocked(companies).alias("blocked"), "structured_source", F.lower(F.coalesce("risk_level", F.lit("unknown"))).alias("risk_level"))
    free, shut = companies.where(~F.col("blocked")), companies.where("blocked")
    bound = bound_fields(fundamentals, evidence)
    none, period, empty = F.lit(None), F.col("period"), _none()
    one = F.array("evidence_id")

    # a ratio is bound if all its inputs are; it has two or three
    given = ratios.where("value is not null").hint("merge").join(free, "company").select("company", "period", "metric", "value", "inputs", F.explode("inputs").alias("input"))
    inputs = given.hint("merge").join(bound.withColumnRenamed("metric", "input"), ["company", "input"], "left")
    inputs = inputs.groupBy("company", "period", "metric", "value").agg(F.bool_and(F.col("evidence_id").isNotNull()).alias("all"), F.array_sort(F.collect_set("evidence_id")).alias("ids"))
    ratio = _claim(inputs, "numeric", F.concat_ws("_", F.lit("num"), "company", "metric"), F.col("metric"), F.col("all"), "formula_inputs_bound", F.lit("unbound_input"), F.col("ids"), F.col("value"), none, "ratio", period)

    stated = fundamentals.where(F.col("metric").isin(*ABSOLUTE) & F.col("value").isNotNull()).hint("merge").join(free, "company").hint("merge").join(bound, ["company", "metric"], "left")
    absolute = _claim(stated, "numeric", F.concat_ws("_", F.lit("abs"), "company", "metric"), F.col("metric"), F.col("evidence_id").isNotNull(), "structured_field_bound", F.lit("no_matching_field"), one, F.col("value"), none, "billion_usd", period)

    # of a company's evidence of one kind the first stands for all
    first = lambda kind, ok=F.lit(True): evidence.where((F.col("kind") == kind) & ok).groupBy("company").agg(F.min_by(F.struct("evidence_id", "text"), "evidence_id").alias("e")).select("company", F.col("e.evidence_id").alias(kind), F.col("e.text").alias(f"{kind}_text"))
    market, supply, risk = first("market"), first("supply"), first("risk")
    page = first("page", F.lower("text").rlike("risk|supply|supplier|concentration"))

    priced = snapshots.where("trailing_pe is not null").hint("merge").join(free, "company").hint("merge").join(market, "company", "left")
    says = number_matches(numbers(F.coalesce("market_text", F.lit(""))), F.round("trailing_pe", 2), 1e-9)
    pe = _claim(priced, "numeric", F.concat_ws("_", F.lit("num"), "company", F.lit("pe_ratio")), F.lit("pe_ratio"), F.col("market").isNotNull() & says, "market_snapshot_bound", F.lit("no_market_evidence"), F.array("market"), F.col("trailing_pe"), none, "multiple", F.lit("latest"))

    withheld = _claim(shut, "numeric", F.concat_ws("_", F.lit("num"), "company", F.lit("blocked")), F.lit("numeric_blocked"), F.lit(False), "", F.lit("no_computable_fundamentals"), empty, none, none, None, none)

    sales = stated.where("metric = 'revenue' and prior is not null and prior <> 0")
    growth = _claim(sales, "growth", F.concat_ws("_", F.lit("growth"), "company", F.lit("revenue")), F.lit("revenue_growth"), F.col("evidence_id").isNotNull(), "both_periods_bound", F.lit("unbound_period"), one, F.round(F.col("value") / F.col("prior") - 1, 6), none, "ratio", period)
    no_growth = _claim(shut, "growth", F.concat_ws("_", F.lit("growth"), "company", F.lit("revenue")), F.lit("revenue_growth"), F.lit(False), "", F.lit("no_computable_fundamentals"), empty, none, none, None, period)

    gap = _claim(shut, "risk_conclusion", F.concat_ws("_", F.lit("risk"), "company", F.lit("supply")), F.lit("data_limitation_risk"), F.lit(True), "data_gap_bound", none, F.array(F.concat(F.lit("ev_gap_"), "company")), none, F.lit("elevated"), None, period)
    chain = free.hint("merge").join(supply, "company", "left").hint("merge").join(page, "company", "left").hint("merge").join(risk, "company", "left")
    known = ~F.col("risk_level").isin(*NO_LEVEL)
    direct = F.filter(F.array("page", "supply"), lambda x: x.isNotNull())
    ids = F.when(F.size(direct) > 0, direct).otherwise(F.array("risk"))
    anything = F.coalesce("page", "supply", "risk").isNotNull()
    signal = _claim(chain, "risk_conclusion", F.concat_ws("_", F.lit("risk"), "company", F.lit("supply")), F.lit("supply_chain_risk"), known & anything, "risk_evidence_bound", F.when(known, "no_risk_evidence").otherwise("unknown_level"), ids, none, F.col("risk_level"), None, period)

    scored = scores.where(F.col("dimension").isin(*DIMENSIONS) & F.col("score").isNotNull()).hint("merge").join(free, "company").hint("merge").join(risk, "company", "left").hint("merge").join(market, "company", "left")
    source = F.when(F.col("dimension") == "market_risk", F.coalesce("market", "risk")).otherwise(F.col("risk"))
    grade = F.when(F.col("score") < 3.5, "Low").when(F.col("score") < 6.5, "Moderate").otherwise("Elevated")
    screens = _claim(scored, "risk_conclusion", F.concat_ws("_", F.lit("risk"), "company", "dimension"), F.col("dimension"), source.isNotNull(), "screening_evidence_bound", F.lit("no_screening_evidence"), F.array(source), F.col("score"), grade, "score_1_10", F.lit("model"))
    return reduce(DataFrame.unionByName, (ratio, absolute, pe, withheld, growth, no_growth, gap, signal, screens))


def thesis(companies: DataFrame, claims: DataFrame) -> DataFrame:
    """(entity, stance, metric_name, value, risk_metric, verification, reason, evidence_ids): a stance on
    every company, from its verified profitability (EBITDA margin, else operating margin) and a
    verified risk (a scored dimension, else the supply chain); rejected without either."""
    ok = claims.where("verification = 'verified'")
    place = lambda names: F.array_position(F.array(*map(F.lit, names)), F.col("metric_name"))
    best = lambda rows, names: rows.withColumn("place", place(names)).where("place > 0").groupBy("entity").agg(F.min_by(F.struct("metric_name", "value", "label", "evidence_ids"), "place").alias("c"))
    profit = best(ok.where("claim_type = 'numeric'"), ("ebitda_margin", "operating_margin")).select("entity", F.col("c").alias("p"))
    risk = best(ok.where("claim_type = 'risk_conclusion'"), ("financial_risk", "market_risk", "operational_risk", "data_limitation_risk", "supply_chain_risk")).select("entity", F.col("c").alias("r"))
    rows = companies.select(F.col("company").alias("entity"), blocked(companies).alias("blocked")).hint("merge").join(profit, "entity", "left").hint("merge").join(risk, "entity", "left")
    good = ~F.col("blocked") & F.col("p").isNotNull() & F.col("r").isNotNull()
    ebitda, v = F.col("p.metric_name") == "ebitda_margin", F.col("p.value")
    stance = F.when(v >= F.when(ebitda, 0.25).otherwise(0.20), "quality").when(v >= F.when(ebitda, 0.15).otherwise(0.12), "neutral").otherwise("defensive")
    reason = F.when(F.col("blocked") | F.col("p").isNull(), "no_verified_profitability").when(F.col("r").isNull(), "no_material_risk").otherwise("composed_of_verified_claims")
    return rows.select(
        "entity",
        F.when(good, stance).alias("stance"),
        F.when(good, F.col("p.metric_name")).alias("metric_name"),
        F.when(good, v).alias("value"),
        F.when(good, F.col("r.metric_name")).alias("risk_metric"),
        F.when(good, "verified").otherwise("rejected").alias("verification"),
        reason.alias("reason"),
        F.when(good, F.concat(F.slice("p.evidence_ids", 1, 1), F.slice("r.evidence_ids", 1, 1))).otherwise(_none()).alias("evidence_ids"),
    )


def metric_records(metrics: DataFrame, formulas: list[tuple[str, str, list[str]]], fundamentals: DataFrame, confidence: DataFrame) -> DataFrame:
    """(entity, name, period, value, formula, inputs, confidence) of metrics (company, metric, period,
    value): formula and input names by (metric, formula, inputs), each input with value, unit and
    provenance from fundamentals (company, metric, value, period, source, citation, record_id), and
    confidence (company, metric, level). A metric without formula has no inputs; an input that the
    company lacks is left out."""
    spec = metrics.sparkSession.createDataFrame(formulas, "metric string, formula string, names array<string>")
    rows = metrics.join(spec, "metric", "left")
    asked = rows.select("company", "metric", F.explode("names").alias("input"))
    have = fundamentals.where("value is not null").select("company", F.col("metric").alias("input"), F.struct("value", F.lit("billion").alias("unit"), F.lit("USD").alias("currency"), "period", F.coalesce("source", F.lit("market_data")).alias("source"), "citation", "record_id").alias("given"))
    found = asked.hint("merge").join(have, ["company", "input"]).groupBy("company", "metric").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("input", "given")))).alias("inputs"))
    out = rows.hint("merge").join(found, ["company", "metric"], "left").hint("merge").join(confidence, ["company", "metric"], "left")
    return out.select(F.col("company").alias("entity"), F.col("metric").alias("name"), "period", "value", F.coalesce("formula", F.lit("")).alias("formula"), "inputs", F.col("level").alias("confidence"))


def nested(claims: DataFrame) -> DataFrame:
    """(entity, claims): the claims of each company as JSON, in order of their ids. A company has as
    many claims as there are rules, not as many as there are documents."""
    return claims.groupBy("entity").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*claims.columns)))).alias("claims"))


def unnested(rows: DataFrame) -> DataFrame:
    """``nested`` read back; what isn't such JSON gives no claims."""
    return rows.select(F.inline(F.from_json("claims", f"array<struct<{CLAIM}>>")))


def ledger(claims: DataFrame) -> DataFrame:
    """(entity, claim_type, statement, source) of verified claims, bars made slashes."""
    number = F.when(F.col("unit") == "ratio", F.concat(F.format_number(F.col("value") * 100, 2), F.lit("%"))).otherwise(F.coalesce(F.format_number("value", 2), "label"))
    bare = lambda c: F.replace(c, F.lit("|"), F.lit("/"))
    statement = F.concat_ws(" ", "entity", F.replace("metric_name", F.lit("_"), F.lit(" ")), F.lit("is"), number)
    return claims.where("verification = 'verified'").select("entity", "claim_type", bare(statement).alias("statement"), bare(F.coalesce(F.try_element_at("evidence_ids", F.lit(1)), F.lit(""))).alias("source"))


def public_answers(answers: DataFrame) -> DataFrame:
    """(answer_id, answer, citations, status) of validated answers (answer_id, answer, citations,
    complete, reason): one that validation refused is replaced by a degraded one that cites nothing, and
    only complete answers show their citations."""
    bad = F.coalesce(F.col("reason") != "ok", F.lit(True))
    status = F.when(bad, "degraded").when(F.col("complete"), "complete").otherwise("incomplete")
    return answers.select("answer_id", F.when(bad, F.concat(F.lit("withheld: "), F.coalesce("reason", F.lit("not_validated")))).otherwise(F.col("answer")).alias("answer"), F.when(status == "complete", F.col("citations")).otherwise(_none()).alias("citations"), status.alias("status"))
