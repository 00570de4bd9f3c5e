"""Claims and evidence: pools, structured matches, citations, answers. Every refusal has a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PRIMARY_SOURCES = ("retrieval", "fundamentals", "document")


def evidence_pool(parts: list[DataFrame]) -> DataFrame:
    """Evidence of all sources on one schema; of an evidence_id the first source's row stays, and a
    period that no fact backs is dropped."""
    rows = parts[0].withColumn("place", F.lit(0))
    for i, part in enumerate(parts[1:], 1):
        rows = rows.unionByName(part.withColumn("place", F.lit(i)), allowMissingColumns=True)
    own = Window.partitionBy("company", "evidence_id").orderBy("place", "value")
    kept = rows.withColumn("nth", F.row_number().over(own)).where("nth = 1").drop("nth", "place")
    return kept.withColumn("period", F.when(F.col("period_source").isin("filing", "caption"), F.col("period")))


def match_structured(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each claim (claim_id, company, metric, value, unit, period) with its best evidence and the
    first reason that fails; a claim is bound if none does."""
    e = evidence.select("company", "metric", *(F.col(c).alias("e_" + c) for c in ("evidence_id", "value", "unit", "period", "confidence")))
    rows = claims.join(e, ["company", "metric"], "left")
    near = F.abs(F.col("value") - F.col("e_value")) <= 1e-4 * F.abs(F.col("e_value"))
    reason = (
        F.when(F.col("e_evidence_id").isNull(), "no_evidence")
        .when(~F.coalesce(near, F.lit(False)), "value_mismatch")
        .when(F.col("unit") != F.col("e_unit"), "unit_mismatch")
        .when(F.col("e_confidence") != "high", "low_confidence")
        .when(F.col("e_period").isNull(), "missing_period")
        .when(F.col("period") != F.col("e_period"), "period_mismatch")
        .otherwise("structured_field_bound")
    )
    order = ("structured_field_bound", "period_mismatch", "missing_period", "low_confidence", "unit_mismatch", "value_mismatch", "no_evidence")
    place = F.array_position(F.array(*(F.lit(x) for x in order)), F.col("reason"))
    best = Window.partitionBy("claim_id").orderBy("place", "e_evidence_id")
    rows = rows.withColumn("reason", reason).withColumn("place", place).withColumn("nth", F.row_number().over(best)).where("nth = 1")
    bound = F.col("reason") == "structured_field_bound"
    return rows.select("claim_id", "company", "metric", bound.alias("matched"), "reason", F.when(bound, F.col("e_evidence_id")).alias("evidence_id"))


def bind(claims: DataFrame, evidence: DataFrame, most: int = 2) -> DataFrame:
    """(claim_id, evidence_id, place): matching evidence of the claim's company, page-anchored ones
    first, at most ``most``."""
    pairs = claims.join(evidence.select("company", "metric", "evidence_id", "page", F.col("value").alias("e_value")), ["company", "metric"])
    close = pairs.where(F.abs(F.col("value") - F.col("e_value")) <= 1e-4 * F.abs(F.col("e_value")))
    order = Window.partitionBy("claim_id").orderBy(F.col("page").isNull(), "evidence_id")
    return close.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most).select("claim_id", "evidence_id", "place")


def validate_answers(answers: DataFrame, allowed: DataFrame, versions: tuple[str, ...] | None = None) -> DataFrame:
    """(answer_id, reason) of answers (answer_id, tenant_id, kind, complete, citations array) against
    allowed evidence (chunk_id, tenant_id, verified, stale). With ``versions`` an answer's
    schema_version must be one of them. Where both sides have a session_id, evidence of another session
    than the answer's isn't its own; an answer without one asks for none."""
    sessions = "session_id" in answers.columns and "session_id" in allowed.columns
    session = F.col("session_id") if sessions else F.lit(None).cast("string")
    cited = answers.select("answer_id", F.col("tenant_id").alias("own"), session.alias("own_session"), F.explode_outer(F.array_distinct("citations")).alias("chunk_id"))
    known = allowed if sessions else allowed.withColumn("session_id", F.lit(None).cast("string"))
    found = cited.hint("merge").join(known, "chunk_id", "left").groupBy("answer_id").agg(
        F.bool_or(F.col("chunk_id").isNotNull() & F.col("tenant_id").isNull()).alias("unknown"),
        F.bool_or(F.col("tenant_id").isNotNull() & (F.col("tenant_id") != F.col("own"))).alias("foreign"),
        F.bool_or(F.col("tenant_id").isNotNull() & (F.col("own_session") != "") & ~F.col("own_session").eqNullSafe(F.col("session_id"))).alias("elsewhere"),
        F.bool_or(~F.col("verified")).alias("unverified"),
        F.bool_or("stale").alias("stale"),
        F.count("chunk_id").alias("n"),
    )
    old = F.lit(False) if versions is None else ~F.coalesce(F.trim("schema_version").isin(*versions), F.lit(False))
    reason = (
        F.when(old, "unsupported_schema")
        .when(~F.col("complete") & (F.col("n") > 0), "incomplete_with_citations")
        .when((F.col("kind") == "fact") & F.col("complete") & (F.col("n") == 0), "fact_without_citation")
        .when(F.col("unknown"), "unknown_citation")
        .when(F.col("foreign"), "cross_tenant")
        .when(F.col("elsewhere"), "cross_session")
        .when(F.col("unverified"), "unverified")
        .when(F.col("stale"), "stale")
        .otherwise("ok")
    )
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("unknown", "foreign", "elsewhere", "unverified", "stale")}
    return answers.join(found.withColumns(flags), "answer_id").select("answer_id", reason.alias("reason"))


def map_markers(texts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(answer_id, marker, chunk_id, mapped) of the [n] markers in a text, through (answer_id,
    marker, chunk_id)."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[(\d+)\]"), F.lit(1)))
    marks = texts.select("answer_id", F.explode(found).alias("m")).select("answer_id", F.col("m").try_cast("long").alias("marker"))
    return marks.hint("merge").join(evidence, ["answer_id", "marker"], "left").withColumn("mapped", F.col("chunk_id").isNotNull())


def score_answers(answers: DataFrame, gold: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(query_id, outcome) of (query_id, numbers, cited, abstained) against (query_id, gold)."""
    from quarry.functions.text import number_matches

    rows = answers.join(gold, "query_id", "left")
    right = number_matches(F.col("numbers"), F.col("gold"), tolerance)
    outcome = F.when(F.col("abstained"), "abstain").when(F.col("gold").isNull(), "invalid_gold").when(right & F.col("cited"), "numeric_match").when(right, "unsupported_match").otherwise("mismatch")
    return rows.select("query_id", outcome.alias("outcome"))
