"""Numbers in texts with what stands around them, and claims that are matched against them.

A text is read once, in an Arrow batch, into a row for each number: its value as printed, whether a unit
is declared near it, the period labels nearest to it, and the characters around it. A claim's value
has a few targets (as printed, as a percentage, in millions, in single dollars), and target and number
meet by equal keys: the company and the number's size class, of which a target takes those within its
slack, one or two. No claim is held against a text without such a number, and no text is shuffled.

A number is taken as printed: 12.3 isn't found in 112.35. Numbers of one digit, and of two where the
claim is below 2, are too common to count unless they are percentages.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import periods as P
from quarry.session import written

# Fixed values of the behaviour that is matched.
TOLERANCE, PERCENT_POINTS, MILLIONS, DOLLARS = 0.02, 0.15, 50.0, 1_000_000.0  # relative, and least absolute ones
SMALL = 1.5  # values up to this are ratios
FEW_PERIODS = 100_000  # of short strings
REACH = 100  # characters from a number to its label
UNIT = r"\b(?:billion|million|thousand|usd|u\.?s\.?\s*dollars?)\b|\$|in\s+millions|in\s+billions|in\s+thousands"

NUMBER = re.compile(r"(?<![\d.,])-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?![\d]|[.,]\d)")
LARGEST = 1.7e308
STEP = 1.5  # numbers of a size class are within this factor
SPAN = "evidence_id string, start int, value double, decimals int, digits int, percent boolean, in_millions boolean, declared boolean, labels array<string>, around string, at int"


def number_spans(texts: DataFrame, *carried: str) -> DataFrame:
    """SPAN rows of texts (evidence_id, text), with the ``carried`` columns of their text. A null text has none."""
    unit = re.compile(UNIT)

    def spans(text: str):
        low = text.lower()
        whole, labels = "in millions" in low, P.labels_around(text)
        for m in NUMBER.finditer(text):
            a, b = m.span()
            token = m[0].replace(",", "")
            before, near = low[max(0, a - 80) : a], low[max(0, a - 60) : a + 60]
            million = whole or "million" in before or "million" in low[b : b + 24]
            wide = before + low[a : a + 40]
            declared = "$" in near or "billion" in wide or "million" in wide or bool(unit.search(near))
            left = max(0, a - REACH)
            yield (
                a,
                float(token),
                len(token.partition(".")[2]),
                len(token) - token.count(".") - token.count("-"),
                text[b : b + 8].lstrip().startswith("%"),
                million,
                declared,
                labels(a, b),
                low[left : a + REACH],
                a - left + 1,
            )

    kinds = (pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.string(), pa.int32())
    names = [c.split()[0] for c in SPAN.split(", ")] + list(carried)

    def run(batches):
        for batch in batches:
            of, out = [], []

            def flush():
                key, _, *more = (c.take(pa.array(of)) for c in batch.columns)
                rows = pa.RecordBatch.from_arrays([key, *(pa.array(c, k) for c, k in zip(zip(*out), kinds)), *more], names=names)
                of.clear(), out.clear()
                return rows

            for i, text in enumerate(batch.column(1).to_pylist()):
                for span in spans(text or ""):
                    of.append(i)
                    out.append(span)
                    if len(out) >= 4000:
                        yield flush()
            if out:
                yield flush()

    types = {f.name: f.dataType.simpleString() for f in texts.schema}
    return texts.select(F.col("evidence_id").cast("string"), F.col("text").cast("string"), *carried).mapInArrow(run, ", ".join([SPAN, *(f"`{c}` {types[c]}" for c in carried)]))


def _size_class(x: Column) -> Column:
    return F.floor(F.log(F.least(F.greatest(F.abs(x), F.lit(1.0)), F.lit(LARGEST))) / F.log(F.lit(STEP))).cast("int")


def targets(claims: DataFrame) -> DataFrame:
    """``claims`` (value, unit, ...) with a row for each form that the value may be printed in: form,
    target, slack (absolute) and bucket. A value that is no number has none."""
    v, ratio = F.col("value"), (F.abs("value") <= SMALL) | (F.col("unit") == F.lit("ratio"))
    form = lambda name, target, least: F.struct(F.lit(name).alias("form"), target.alias("target"), F.greatest(F.lit(least), F.abs(target) * TOLERANCE).alias("slack"))
    forms = F.array(
        form("printed", v, 0.0),
        F.when(F.coalesce(ratio, F.lit(False)), form("percent", F.when(F.abs(v) <= SMALL, v * 100).otherwise(v), PERCENT_POINTS)),
        F.when(~F.coalesce(ratio, F.lit(False)), form("million_to_billion", v * 1000, MILLIONS)),
        F.when(~F.coalesce(ratio, F.lit(False)), form("raw_usd_to_billion", v * 1e9, DOLLARS)),
    )
    sound = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = claims.where(sound).withColumn("_form", F.explode(F.filter(forms, lambda f: f.isNotNull()))).select("*", "_form.*").drop("_form")
    size, reach = F.abs("target"), F.greatest("slack", F.lit(0.5)) * 1.001 + 1e-6  # a printed number is at most half a unit off
    return rows.withColumn("bucket", F.explode(F.sequence(_size_class(F.greatest(size - reach, F.lit(1.0))), _size_class(size + reach))))


def alias_distance(around: Column, at: Column, metric: Column) -> Column:
    """Characters from ``at`` to the nearest start of one of the metric's aliases (or of its name), null
    without any."""
    aliases = F.array(F.replace(metric, F.lit("_"), F.lit(" ")))
    for name, words in T.METRIC_ALIASES:
        aliases = F.when(metric == name, F.array(*(F.lit(w.lower()) for w in words))).otherwise(aliases)

    def distance(alias: Column, back: Column) -> Column:
        right = F.call_function("locate", alias, around, at)
        past = F.length(around) - at - F.length(alias) + 3  # an alias that starts before `at` starts here, read backwards, at least
        left = F.call_function("locate", F.reverse(alias), back, F.greatest(past, F.lit(1)))
        start = F.length(around) - left - F.length(alias) + 2
        return F.least(F.when(right > 0, right - at), F.when(left > 0, at - start))

    return T._bound(F.reverse(around), lambda back: F.array_min(F.transform(F.filter(aliases, lambda a: (a != "") & F.contains(around, a)), lambda a: distance(a, back))))


def _with_period(rows: DataFrame) -> DataFrame:
    """``rows`` (claim_period, labels, own_period) with ``period``, the status of ``match_near``: judged once for
    each distinct three, which are broadcast, if there are at most FEW_PERIODS of them."""
    three = ["claim_period", "labels", "own_period"]
    status = P.match_near(*map(F.col, three))["status"]
    known = written(rows.select(three).distinct(), "period-cases")
    if known.count() > FEW_PERIODS:
        return rows.withColumn("period", status)
    known = written(known.withColumn("period", status), "period-statuses").select(*(F.col(c).alias(f"_{c}") for c in three), "period")
    return rows.join(F.broadcast(known), reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in three))).drop(*(f"_{c}" for c in three))


def match_numbers(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, evidence_id, matched, reason, matched_value, unit_conversion, confidence, start) of
    claims (claim_id, company, metric, value in billions or a ratio, unit, period) and texts
    (evidence_id, company, text, period): a row for each text of the company that has the number, by the
    occurrence nearest to the metric's label, and one without a text for a claim that none has.
    Reasons, the first that holds: number_not_found, period_unknown, period_mismatch,
    period_ambiguous, period_metadata_conflict, metric_label_mismatch, unit_ambiguous, bound."""
    claims = claims.select(F.col("claim_id").cast("string").alias("claim_id"), "company", F.coalesce("metric", F.lit("")).alias("metric"), F.col("value").cast("double").alias("value"), "unit", F.col("period").alias("claim_period"))
    spans = number_spans(evidence.withColumnRenamed("period", "own_period"), "company", "own_period").where("digits > 1 or percent")
    spans = spans.withColumn("bucket", _size_class(F.col("value"))).withColumnRenamed("value", "found")
    rows = targets(claims).hint("merge").join(spans, ["company", "bucket"])
    off = F.abs(F.col("found") - F.col("target"))
    usable = (F.col("digits") > 2) | ((F.col("digits") == 2) & (F.abs("value") >= 2.0))
    right = (
        F.when(F.col("form") == "printed", usable & (off <= 0.5 * F.pow(F.lit(10.0), -F.col("decimals")) + 1e-9))
        .when(F.col("form") == "percent", F.col("percent") & (off <= F.col("slack")))
        .when(F.col("form") == "million_to_billion", F.col("in_millions") & (F.col("digits") > 2) & (off <= F.col("slack")))
        .otherwise((F.col("digits") > 2) & (off <= F.col("slack")))
    )
    value = (
        F.when(F.col("form") == "million_to_billion", F.col("found") / 1000)
        .when(F.col("form") == "raw_usd_to_billion", F.col("found") / 1e9)
        .when((F.col("form") == "percent") & (F.abs("value") <= SMALL), F.col("found") / 100)
        .otherwise(F.when(F.col("form") == "percent", F.col("found")).otherwise(F.col("value")))
    )
    conversion = F.when(F.col("form").isin("million_to_billion", "raw_usd_to_billion"), F.col("form"))
    hits = rows.where(right).withColumns({"distance": alias_distance(F.col("around"), F.col("at"), F.col("metric")), "matched_value": value, "unit_conversion": conversion})
    order = F.struct(F.coalesce("distance", F.lit(10_000)), "start", F.col("unit_conversion").isNull(), "form")
    kept = ("distance", "start", "matched_value", "unit_conversion", "declared", "percent", "labels", "own_period", "claim_period", "unit", "value")
    best = hits.groupBy("claim_id", "evidence_id").agg(F.min_by(F.struct(*kept), order).alias("b")).select("claim_id", "evidence_id", "b.*")
    best = _with_period(written(best, "number-hits"))
    amount = (F.abs("value") > SMALL) & (F.coalesce("unit", F.lit("billion_usd")) != "ratio") & ~F.col("percent")
    reason = (
        F.when(F.col("period").isin("unknown", "mismatch", "ambiguous"), F.concat(F.lit("period_"), "period"))
        .when(F.col("period") == "metadata_conflict", "period_metadata_conflict")
        .when(F.col("distance").isNull(), "metric_label_mismatch")
        .when(amount & F.col("unit_conversion").isNull() & ~F.col("declared"), "unit_ambiguous")
        .otherwise("bound")
    )
    sure = F.when(F.col("reason") == "bound", F.when(F.col("unit_conversion").isNotNull() | F.col("declared"), "high").otherwise("medium")).when(F.col("reason") == "unit_ambiguous", "low").otherwise("none")
    found = best.withColumn("reason", reason).select("claim_id", "evidence_id", (F.col("reason") == "bound").alias("matched"), "reason", "matched_value", "unit_conversion", sure.alias("confidence"), "start")
    lost = claims.select("claim_id").distinct().hint("merge").join(best.select("claim_id").distinct(), "claim_id", "left_anti")
    none = lambda kind: F.lit(None).cast(kind)
    return found.unionByName(lost.select("claim_id", none("string").alias("evidence_id"), F.lit(False).alias("matched"), F.lit("number_not_found").alias("reason"), none("double").alias("matched_value"), none("string").alias("unit_conversion"), F.lit("none").alias("confidence"), none("int").alias("start")))


def match_formulas(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, evidence_id, matched, reason) of claims (claim_id, company, inputs map<metric, value>,
    period): a text must bind every input. Otherwise the reason is the first of: an input that is null,
    absent or not in the text (formula_input_incomplete), its period, its label, its unit. Without a
    text that has any input there is one row, without evidence."""
    inputs = written(claims.select(F.col("claim_id").cast("string").alias("claim_id"), "company", "period", F.explode_outer("inputs").alias("metric", "value")), "formula-inputs")
    sizes = inputs.groupBy("claim_id").agg(F.count("metric").alias("n"), F.count("value").alias("n_values"))
    parts = inputs.where("value is not null").withColumns({"unit": F.lit("billion_usd"), "claim_id": F.to_json(F.struct("claim_id", "metric"))})
    found = match_numbers(parts, evidence).where("evidence_id is not null").withColumn("claim_id", F.get_json_object("claim_id", "$.claim_id"))
    reasons = ("period_unknown", "period_mismatch", "period_ambiguous", "period_metadata_conflict", "metric_label_mismatch", "unit_ambiguous")
    place = F.array_position(F.array(*map(F.lit, reasons)), F.col("reason"))
    each = found.groupBy("claim_id", "evidence_id").agg(F.count("*").alias("n_found"), F.min(F.when(~F.col("matched"), place)).alias("place"))
    rows = sizes.hint("merge").join(each, "claim_id", "left")
    worst = F.try_element_at(F.array(*map(F.lit, reasons)), F.col("place").cast("int"))
    reason = (
        F.when((F.col("n") == 0) | (F.col("n_values") < F.col("n")) | F.col("n_found").isNull() | (F.col("n_found") < F.col("n")), "formula_input_incomplete")
        .when(worst.isin("period_unknown", "period_mismatch", "period_ambiguous"), F.concat(F.lit("formula_input_"), worst))
        .otherwise(F.coalesce(worst, F.lit("formula_inputs_bound")))
    )
    return rows.select("claim_id", "evidence_id", (reason == "formula_inputs_bound").alias("matched"), reason.alias("reason"))
