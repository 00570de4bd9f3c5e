"""Fundamentals in long form: selection, merging, scaling, ratios, scores. One row a company, metric
and period; a refused row keeps its reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the behaviour that is matched.
CANONICAL = ("revenue", "ebitda", "r_and_d", "operating_income", "subsidiary_revenue")
MOST_REVENUE_BILLION = 800.0
USD_PER_UNIT = {"USD": 1.0, "EUR": 1.08, "GBP": 1.27, "JPY": 0.0067, "CNY": 0.14}
REPAIRS = (
    ("missing_quantitative_results", "quant", 100),
    ("missing_sentiment_analysis", "psychologist", 90),
    ("missing_structured_data", "retrieval", 80),
    ("low_retrieval_confidence", "retrieval", 70),
    ("missing_risk_disclaimer", "quant", 20),
    ("missing_data_provenance", "quant", 10),
)
RISK_LEVELS = {"low": (2.5, 2.0), "medium": (5.5, 5.0), "high": (8.0, 8.0)}


def canonical_name(key: Column) -> Column:
    """The fundamental that a key names, a year at its end left out; null for other keys."""
    base = F.regexp_extract(key, rf"^({'|'.join(CANONICAL)})(?:_20\d{{2}})?$", 1)
    return F.when(base != "", base)


def period_label(fiscal_year: Column, period: Column, fy: Column, period_end: Column) -> Column:
    some = lambda c: F.when(F.trim(c.cast("string")) != "", c.cast("string"))
    year = lambda c: F.when(c.rlike(r"^20\d{2}$"), F.concat(F.lit("FY"), c)).otherwise(c)
    digits = lambda c: F.when(c.rlike(r"^\d+$"), F.concat(F.lit("FY"), c)).otherwise(year(c))
    return F.coalesce(F.concat(F.lit("FY"), some(fiscal_year)), year(some(period)), digits(some(fy)), year(some(period_end)), F.lit("latest"))


def plausible_revenue(value: Column) -> Column:
    return F.coalesce((value > 0) & (value <= MOST_REVENUE_BILLION), F.lit(False))


def wide(facts: DataFrame, metrics=CANONICAL[:4], by=("company", "fy")) -> DataFrame:
    return facts.groupBy(*by).pivot("metric", list(metrics)).agg(F.first("value"))


def latest(facts: DataFrame, requested: int | None = None) -> DataFrame:
    """The value of each company and metric: of the requested year if there, else the last."""
    exact = (F.col("fy") == requested).cast("int") if requested is not None else F.lit(0)
    order = Window.partitionBy("company", "metric").orderBy(exact.desc(), F.desc("fy"), F.desc("value"))
    return facts.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def same_period(facts: DataFrame, anchor: str, companion: str) -> DataFrame:
    """(company, fy, anchor, companion, aligned): the companion of the anchor's latest year, else
    the companion's own latest."""
    a = latest(facts.where(F.col("metric") == anchor)).select("company", "fy", F.col("value").alias("anchor_value"))
    c = facts.where(F.col("metric") == companion)
    exact = c.select("company", "fy", F.col("value").alias("exact"))
    last = latest(c).select("company", F.col("value").alias("last"))
    return (
        a.join(exact, ["company", "fy"], "left")
        .join(last, "company", "left")
        .select("company", "fy", "anchor_value", F.coalesce("exact", "last").alias("companion_value"), F.col("exact").isNotNull().alias("aligned"))
    )


def fill_gaps(document: DataFrame, live: DataFrame) -> DataFrame:
    """Document values first; what they lack comes from live ones and is marked."""
    return document.withColumnRenamed("value", "d").join(live.withColumnRenamed("value", "l"), ["company", "metric"], "full").select(
        "company", "metric", F.coalesce("d", "l").alias("value"), (F.col("d").isNull() & F.col("l").isNotNull()).alias("filled")
    )


def by_precedence(sources: list[tuple[str, DataFrame]], needed: int) -> DataFrame:
    """(company, metric, value, source) of the first source, in order, that has at least ``needed``
    metrics of the company."""
    rows = reduce(DataFrame.unionByName, (df.select("company", "metric", "value", F.lit(name).alias("source"), F.lit(i).alias("place")) for i, (name, df) in enumerate(sources)))
    own = Window.partitionBy("company", "source")
    complete = rows.withColumn("n", F.count("*").over(own)).where(F.col("n") >= needed)
    best = Window.partitionBy("company")
    return complete.withColumn("best", F.min("place").over(best)).where("place = best").select("company", "metric", "value", "source")


def to_billion_usd(rows: DataFrame) -> DataFrame:
    """``rows`` (company, value, currency) with value_billion and reason: an unknown currency, no
    revenue or an implausible one is refused."""
    rate = F.element_at(F.create_map(*(x for k, v in USD_PER_UNIT.items() for x in (F.lit(k), F.lit(v)))), F.col("currency"))
    rate = F.when(F.col("currency").isin(*USD_PER_UNIT), rate)
    value = F.round(F.col("value") * rate / 1e9, 8)
    reason = F.when(rate.isNull(), "unknown_currency").when(F.col("value").isNull() | (F.col("value") == 0), "zero_revenue").when(~plausible_revenue(value), "implausible").otherwise("ok")
    return rows.withColumn("reason", reason).withColumn("value_billion", F.when(F.col("reason") == "ok", value))


def ratios(companies: DataFrame) -> DataFrame:
    """Ratios of wide rows: exact where three inputs are there, else derived; with a confidence."""
    r, e, d, o = (F.col(c) for c in ("revenue", "ebitda", "r_and_d", "operating_income"))
    inputs = sum((c.isNotNull().cast("int") for c in (r, e, d, o)), F.lit(0))
    over = lambda x: F.when(r > 0, F.round(x / r, 4))
    return companies.withColumns(
        {
            "ebitda_margin": over(e),
            "r_and_d_intensity": over(d),
            "operating_margin": over(o),
            "estimated_net_margin": over(e * 0.55),
            "estimated_fcf_margin": over(e * 0.40),
            "confidence": F.when(r > 0, F.when(inputs >= 3, 0.95).otherwise(0.72)),
        }
    )


def computable(revenue: Column, *others: Column) -> Column:
    return F.coalesce(revenue != 0, F.lit(False)) & reduce(lambda a, b: a | b, (F.coalesce(c != 0, F.lit(False)) for c in others))


def risk_scores(rows: DataFrame) -> DataFrame:
    """Five scores and their mean from ebitda_margin, risk_level, n_flags, positive, caution, range_position.
    Ties are rounded up, also where a double is just below one (9 - 0.17 * 15)."""
    level = lambda i: reduce(lambda acc, kv: F.when(F.col("risk_level") == kv[0], kv[1][i]).otherwise(acc), RISK_LEVELS.items(), F.lit(5.0))
    market = 5.0 + F.when(F.col("caution") > F.col("positive"), 1.8).otherwise(0.0) + F.when(F.col("range_position") > 0.8, 1.2).when(F.col("range_position") < 0.2, -1.0).otherwise(0.0)
    out = rows.withColumns(
        {
            "financial_risk": F.round(F.greatest(F.lit(1.5), F.least(F.lit(9.5), 9.0 - F.coalesce("ebitda_margin", F.lit(0.15)) * 15)) + 1e-9, 1),
            "operational_risk": F.round(F.least(F.lit(9.5), level(0) + F.col("n_flags") * 0.6), 1),
            "market_risk": F.round(F.greatest(F.lit(1.0), F.least(F.lit(9.5), market)), 1),
            "regulatory_risk": F.lit(3.5),
            "supply_chain_risk": level(1),
        }
    )
    names = ("financial_risk", "operational_risk", "market_risk", "regulatory_risk", "supply_chain_risk")
    return out.withColumn("mean_risk", F.round(sum((F.col(c) for c in names), F.lit(0.0)) / 5 + 1e-9, 2))


def scenarios(rows: DataFrame) -> DataFrame:
    """Base, bull and bear growth with their probabilities, a row each."""
    growth = F.when(F.coalesce("ebitda_margin", F.lit(0.15)) > 0.25, 0.08).otherwise(0.05)
    bull = F.when(F.coalesce("r_and_d_intensity", F.lit(0.05)) > 0.06, 0.3).otherwise(0.2)
    case = lambda name, g, p: F.struct(F.lit(name).alias("scenario"), F.round(g, 4).alias("growth"), F.round(p, 4).alias("probability"))
    return rows.select("company", F.inline(F.array(case("base", growth, F.lit(0.5)), case("bull", growth * 1.8, bull), case("bear", growth * 0.3, 0.5 - bull))))


def growth(facts: DataFrame, metric: str = "revenue") -> DataFrame:
    """Growth on the year before, if that is there and not zero; else the reason."""
    own = Window.partitionBy("company").orderBy("fy")
    rows = facts.where(F.col("metric") == metric).withColumns({"prior": F.lag("value").over(own), "prior_fy": F.lag("fy").over(own)})
    reason = F.when(F.col("prior").isNull(), "no_prior_period").when(F.col("prior_fy") != F.col("fy") - 1, "period_gap").when(F.col("prior") == 0, "zero_prior").otherwise("ok")
    return rows.withColumn("reason", reason).select("company", "fy", "reason", F.when(F.col("reason") == "ok", F.round(F.col("value") / F.col("prior") - 1, 4)).alias("growth"))


def repair_targets(violations: DataFrame) -> DataFrame:
    """(run_id, target): of each run's violations (run_id, code) the target of the foremost policy."""
    policies = violations.sparkSession.createDataFrame(list(REPAIRS), "code string, target string, priority int")
    return violations.join(F.broadcast(policies), "code", "left").groupBy("run_id").agg(F.coalesce(F.max_by("target", F.struct("priority", "target")), F.lit("quant")).alias("target"))


def coverage(companies: DataFrame) -> DataFrame:
    """Per run: companies, comparable ones, and whether only some of them are."""
    return companies.groupBy("run_id").agg(F.count("*").alias("n_companies"), F.count_if("comparable").alias("n_comparable")).withColumn(
        "partial_gap", (F.col("n_comparable") >= 1) & (F.col("n_comparable") < F.col("n_companies"))
    )


def compile_formula(formula: str, names) -> Column:
    """A column for + - * / ** and unary minus over named columns and numbers; anything else, and
    a name that isn't in ``names``, is an error. Division by zero is null. Rounded to 4 digits."""
    import ast

    def build(node) -> Column:
        if isinstance(node, ast.Expression):
            return build(node.body)
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            if node.id not in names:
                raise KeyError(node.id)
            return F.col(node.id).cast("double")
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -build(node.operand)
        if isinstance(node, ast.BinOp):
            a, b = build(node.left), build(node.right)
            for kind, make in ((ast.Add, lambda: a + b), (ast.Sub, lambda: a - b), (ast.Mult, lambda: a * b), (ast.Div, lambda: F.try_divide(a, b)), (ast.Pow, lambda: F.pow(a, b))):
                if isinstance(node.op, kind):
                    return make()
        raise ValueError(f"not allowed in a formula: {ast.dump(node)}")

    return F.round(build(ast.parse(formula, mode="eval")), 4)
