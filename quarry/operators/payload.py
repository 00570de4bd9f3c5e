"""What documents say of a company: its fundamentals with their provenance, all amounts that were seen,
those refused, quotes, and the level of supply risk.

A company may have any number of documents. Nothing of a document but its keys and flags meets another's;
fundamentals are the last of their key, kept by partial aggregates; quotes stay rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.entities import trusted_amount
from quarry.operators.finance import plausible_revenue
from quarry.session import written

# Fixed values of the behaviour that is matched.
FUNDAMENTALS = ("revenue", "ebitda", "r_and_d", "operating_income")
PERIOD_WORDS = ("annual", "quarter", "ttm", "latest")
EXCERPT, QUOTE = 3000, 500
AMOUNT = ("normalized_value", "unit", "currency", "confidence", "period", "period_type", "period_end", "source", "provider", "is_normalized", "citation", "record_id")


def base_metric(metric: Column) -> Column:
    """The fundamental that a key names, by itself or with a year behind it; null for other keys."""
    return F.nullif(F.regexp_extract(metric, rf"^({'|'.join(FUNDAMENTALS)})(?:_20\d{{2}})?$", 1), F.lit(""))


def applicable(documents: DataFrame) -> DataFrame:
    """(company, n_companies, doc_id, ...) of documents (doc_id, companies, ...): a document counts for each
    company that was detected in it, and for no other. Of the same name twice, one counts."""
    named = F.array_distinct(F.filter(F.coalesce("companies", F.array().cast("array<string>")), lambda c: F.trim(c) != ""))
    rows = documents.withColumn("companies", named).withColumn("n_companies", F.size("companies"))
    return rows.withColumn("company", F.explode("companies")).drop("companies")


def scoped_amounts(documents: DataFrame, amounts: DataFrame) -> DataFrame:
    """(company, doc_id, doc_pos, doc_citation, amount_no, metric, ...AMOUNT) of ``applicable`` documents and
    amounts (doc_id, company or null, amount_no, metric, ...AMOUNT).

    A document's amounts of a company stand alone; those of no company count where the document has none
    of the company's and names no other."""
    own = documents.select("company", "n_companies", "doc_id", "doc_pos", F.col("citation").alias("doc_citation"))
    a = amounts.select("doc_id", F.col("company").alias("of"), "amount_no", "metric", *AMOUNT)
    direct = own.hint("merge").join(a.where("of is not null").withColumnRenamed("of", "company"), ["doc_id", "company"])
    alone = own.where("n_companies = 1").hint("merge").join(a.where("of is not null").select("doc_id", F.col("of").alias("company")).distinct(), ["doc_id", "company"], "left_anti")
    general = alone.hint("merge").join(a.where("of is null").drop("of"), "doc_id")
    return direct.select("company", "doc_id", "doc_pos", "doc_citation", "amount_no", "metric", *AMOUNT).unionByName(general.select("company", "doc_id", "doc_pos", "doc_citation", "amount_no", "metric", *AMOUNT))


def judged(rows: DataFrame) -> DataFrame:
    """``rows`` with ``base`` and the reason why an amount isn't a fundamental, null if it is one."""
    rows = rows.withColumn("base", base_metric(F.col("metric")))
    reason = (
        F.when(F.col("base").isNull(), "not_fundamental")
        .when(F.col("source").isNull(), "legacy_unverified")
        .when(~trusted_amount(F.col), "untrusted")
        .when((F.col("base") == "revenue") & ~plausible_revenue(F.col("normalized_value")), "implausible")
    )
    return rows.withColumn("refused", reason)


def company_payloads(documents: DataFrame, amounts: DataFrame) -> dict[str, DataFrame]:
    """Tables of documents (doc_id, doc_pos, companies, text, excerpt, citation), in the order of (doc_pos,
    doc_id), and their amounts (as in ``scoped_amounts``):

    - ``fundamentals`` (company, metric, value, doc_id, provenance): the last trusted and, for revenue,
      plausible amount of each key. A period that is a word becomes the period's type. The record is
      the amount's own, else document and metric; the citation its own, else the document's.
    - ``observations`` (company, metric, value, confidence, source, doc_id, refused): the last amount of each
      key, fundamental or not, with the reason for which it isn't one.
    - ``quotes`` (company, doc_pos, doc_id, quote): the beginnings of excerpts that aren't empty.
    - ``companies`` (company, n_documents, n_signals, risk_level, n_quotes, structured_source): a line for each
      company that has a document.

    Documents without companies, and amounts without a document, appear nowhere; of a null text or excerpt
    nothing is said. Amounts that tie in (doc_pos, doc_id, amount_no) are told apart by their values."""
    said = documents.select(
        "companies", "doc_id", "doc_pos", "citation",
        F.coalesce(T.any_of(F.lower("text"), T.SUPPLY_PHRASES), F.lit(False)).alias("signal"),
        F.nullif(F.substring(F.substring("excerpt", 1, EXCERPT), 1, QUOTE), F.lit("")).alias("quote"),
    )
    lean = written(applicable(said), "company-documents")
    rows = written(judged(scoped_amounts(lean, amounts)), "company-amounts")
    at = F.struct("doc_pos", "doc_id", "amount_no", *AMOUNT, "doc_citation")

    word = F.lower("s.period").isin(*PERIOD_WORDS)
    last = rows.where("refused is null").groupBy("company", "metric", "base").agg(F.max(at).alias("s"))
    fundamentals = last.select(
        "company", "metric", F.col("s.normalized_value").alias("value"), "s.doc_id",
        F.struct(
            F.when(F.col("s.source") == "provider_metadata", "provider_metadata").otherwise("document_extracted").alias("source"),
            F.col("s.confidence").alias("confidence"),
            F.col("s.source").alias("normalization_source"),
            F.col("s.provider").alias("provider"),
            F.when(~F.coalesce(word, F.lit(False)), F.col("s.period")).alias("period"),
            F.when(word, F.lower("s.period")).otherwise(F.col("s.period_type")).alias("period_type"),
            F.col("s.period_end").alias("period_end"),
            F.coalesce("s.citation", "s.doc_citation").alias("citation"),
            F.coalesce("s.record_id", F.concat(F.lit("document:"), F.col("s.doc_id").cast("string"), F.lit(":"), "base")).alias("source_record_id"),
        ).alias("provenance"),
    )
    seen = rows.groupBy("company", "metric").agg(F.max(F.struct("doc_pos", "doc_id", "amount_no", *AMOUNT, "refused")).alias("s"))
    observations = seen.select("company", "metric", F.col("s.normalized_value").alias("value"), "s.confidence", F.coalesce("s.source", F.lit("legacy_unverified")).alias("source"), "s.doc_id", "s.refused")
    quotes = lean.where("quote is not null").select("company", "doc_pos", "doc_id", "quote")
    per = lean.groupBy("company").agg(F.count("*").alias("n_documents"), F.count_if("signal").alias("n_signals"), F.count("quote").alias("n_quotes"))
    structured = rows.where("refused is null").select("company").distinct().withColumn("structured", F.lit(True))
    companies = per.hint("merge").join(structured, "company", "left").select(
        "company", "n_documents", "n_signals", F.when(F.col("n_signals") > 0, "medium").otherwise("unknown").alias("risk_level"), "n_quotes",
        F.when(F.col("structured"), "document_extracted").otherwise("none").alias("structured_source"),
    )
    return {"fundamentals": fundamentals, "observations": observations, "quotes": quotes, "companies": companies}
