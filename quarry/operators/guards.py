"""Instructions hidden in uploaded texts or retrieved passages: findings, redaction, and whether to go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

MODES = ("sanitize", "block")


def findings_in(text: Column) -> Column:
    """array<struct<pattern, severity, matched>>: every match of every pattern, in the patterns' order."""

    def matches(name: str, severity: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(F.lit(name).alias("pattern"), F.lit(severity).alias("severity"), F.trim(m).alias("matched")))

    return F.concat(*(matches(*rule) for rule in T.INJECTIONS))


def guard_texts(texts: DataFrame) -> DataFrame:
    """``texts`` (text, ...) redacted, with their findings and whether they were changed. A null text is
    left null, without findings."""
    found = F.coalesce(findings_in(F.col("text")), F.array().cast("array<struct<pattern:string,severity:string,matched:string>>"))
    rows = texts.withColumn("findings", found)
    changed = F.size("findings") > 0
    return rows.withColumns({"text": F.when(changed, T.redacted(F.col("text"))).otherwise(F.col("text")), "guardrail_sanitized": changed})


def verdicts(guarded: DataFrame, mode: str, *by: str) -> DataFrame:
    """(by, n_texts, n_critical, n_warning, allowed, blocked_reason) of texts that ``guard_texts`` has
    seen: only ``block`` mode refuses, where there is a critical finding."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    of = lambda severity: F.sum(F.size(F.filter("findings", lambda f: f["severity"] == severity))).cast("long")
    rows = guarded.groupBy(*by).agg(F.count("*").alias("n_texts"), of("critical").alias("n_critical"), of("warning").alias("n_warning"))
    refused = (F.col("n_critical") > 0) & F.lit(mode == "block")
    reason = F.format_string("Blocked %d critical prompt-injection pattern(s) across %d text(s).", "n_critical", "n_texts")
    return rows.withColumns({"allowed": ~refused, "blocked_reason": F.when(refused, reason)})
