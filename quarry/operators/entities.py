"""Companies in texts and directories; facts and amounts near their labels; hits across companies."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import written

# Fixed values of the behaviour that is matched.
METRIC_LABELS = {
    "revenue": ("total revenue", "net sales", "revenue", "营业收入", "营收"),
    "ebitda": ("ebitda",),
    "r_and_d": ("research and development", "r&d", "研发"),
    "operating_income": ("income from operations", "operating income", "营业利润"),
}
SCALES = {"billion": 1.0, "million": 1e-3, "thousand": 1e-6}
TRUSTED_SOURCES = ("table_caption", "inline_unit", "structured_table", "provider_metadata")


FEW_ALIASES = 200


def mentions(texts: DataFrame, aliases: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, company) of (key, text) and (alias, company): an alias of one short Latin word must
    stand as a word, any other may stand anywhere. Words are joined by equality. Up to FEW_ALIASES other
    aliases are looked up in each text; more are joined by their first characters, as many as the
    shortest has, with the texts' runs of that length, and then looked for in those texts alone."""
    word = (F.length("alias") < 6) & F.col("alias").rlike("^[a-z0-9]+$")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))
    by_word = texts.select(key, words.alias("ws")).select(key, F.explode("ws").alias("alias")).hint("merge").join(aliases.where(word), "alias").select(key, "company")
    long = aliases.where(~word & (F.length("alias") > 0))
    n, k = long.agg(F.count("*"), F.min(F.length("alias"))).first()
    low = F.lower("text")
    if n <= FEW_ALIASES:
        pairs = [(r.alias, r.company) for r in long.select("alias", "company").collect()]
        found = F.filter(F.array(*(F.when(low.contains(a), F.lit(c)) for a, c in pairs)), lambda x: x.isNotNull()) if pairs else F.array().cast("array<string>")
        anywhere = texts.select(key, found.alias("cs")).select(key, F.explode("cs").alias("company"))
    else:
        heads = written(long.select(F.substring("alias", 1, k).alias("head"), "alias", "company"), "aliases")
        runs = F.when(F.length("low") >= k, F.transform(F.sequence(F.lit(1), F.length("low") - (k - 1)), lambda i: F.substring(F.col("low"), i, F.lit(k))))
        lowered = texts.select(key, low.alias("low"))
        near = lowered.select(key, F.explode(F.array_distinct(runs)).alias("head")).hint("merge").join(heads, "head").select(key, "alias", "company")
        anywhere = written(near, "near").hint("merge").join(lowered, key).where(F.contains("low", "alias")).select(key, "company")
    return by_word.unionByName(anywhere).distinct()


def resolve_tickers(companies: DataFrame, curated: DataFrame, directory: DataFrame) -> DataFrame:
    """(company, ticker, method): curated name, exact ticker, exact title, then a title that holds the
    company's name as whole words, if there is one such title and the name has four characters."""
    low = F.lower("company")
    steps = [
        companies.join(curated.select(F.lower("name").alias("k"), F.col("ticker")), low == F.col("k")).select("company", "ticker", F.lit("curated").alias("method"), F.lit(0).alias("place")),
        companies.join(directory.select("ticker"), F.upper("company") == F.col("ticker")).select("company", "ticker", F.lit("ticker").alias("method"), F.lit(1).alias("place")),
        companies.join(directory.select("normalized", "ticker"), low == F.col("normalized")).groupBy("company").agg(F.min("ticker").alias("ticker")).select("company", "ticker", F.lit("title").alias("method"), F.lit(2).alias("place")),
    ]
    # a title offers itself under each run of its words, so the match is an equality; titles are short
    parts = F.split("normalized", " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda a: F.transform(F.sequence(F.lit(1), F.size(parts) - a + 1), lambda n: F.array_join(F.slice(parts, a, n), " "))))
    heads = directory.select("ticker", F.explode(F.array_distinct(runs)).alias("k")).where(F.length("k") >= 4)
    unique = companies.select("company", low.alias("k")).hint("merge").join(heads, "k").groupBy("company").agg(F.min("ticker").alias("ticker"), F.count_distinct("ticker").alias("n")).where("n = 1")
    steps.append(unique.select("company", "ticker", F.lit("unique_title").alias("method"), F.lit(3).alias("place")))
    best = reduce(DataFrame.unionByName, steps).groupBy("company").agg(F.min_by(F.struct("ticker", "method"), F.struct("place", "ticker")).alias("b"))
    return companies.join(best, "company", "left").select("company", "b.ticker", "b.method")


def company_universe(queries: DataFrame, directory: DataFrame, stop: DataFrame) -> DataFrame:
    """(query_id, company, ticker, method) of queries (query_id, text, companies array): the companies
    named, resolved against directory (ticker, title, normalized), and the bare upper-case tickers in the
    text that the directory has, that no stop word (word) is, and that aren't there already. A ticker
    that the directory lists with several titles is the least title's."""
    named = queries.select("query_id", F.explode("companies").alias("company")).where(F.trim("company") != "").distinct()
    curated = directory.select(F.col("title").alias("name"), "ticker")
    found = resolve_tickers(written(named.select("company").distinct(), "companies"), curated, directory)
    first = named.hint("merge").join(found, "company", "left").select("query_id", "company", "ticker", F.coalesce("method", F.lit("unresolved")).alias("method"))
    words = queries.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\b[A-Z]{2,5}\b"), F.lit(0)))).alias("ticker"))
    bare = words.hint("merge").join(stop.select(F.col("word").alias("ticker")), "ticker", "left_anti").hint("merge").join(directory.groupBy("ticker").agg(F.min("title").alias("title")), "ticker")
    first = written(first, "named")
    more = bare.hint("merge").join(first.where("ticker is not null").select("query_id", "ticker").distinct(), ["query_id", "ticker"], "left_anti")
    return first.unionByName(more.select("query_id", F.col("title").alias("company"), "ticker", F.lit("query_token").alias("method")))


def company_pages(pages: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, rejects) of pages (document_id, issuers, detected, ...) about the wanted companies (company):
    a page's issuers count, or what was detected if it has none. Pages without an id, and ids that come
    twice, are rejected with a reason."""
    about = F.when(F.coalesce(F.size("issuers"), F.lit(0)) > 0, F.col("issuers")).otherwise(F.col("detected"))
    rows = pages.withColumn("about", about).withColumn("row", F.xxhash64("document_id", "about"))
    named = rows.select("document_id", "row", F.explode("about").alias("company")).hint("merge").join(wanted.select("company").distinct(), "company", "left_semi").select(F.coalesce("document_id", F.lit("")).alias("id"), "row").distinct()
    kept = rows.withColumn("id", F.coalesce("document_id", F.lit(""))).hint("merge").join(named, ["id", "row"], "left_semi")
    n = F.count("*").over(Window.partitionBy("id"))
    reason = F.when(F.trim("id") == "", "missing_id").when(F.col("n") > 1, "duplicate_id")
    kept = kept.withColumn("n", n).withColumn("reason", reason)
    return kept.where("reason is null").select(pages.columns), kept.where("reason is not null").select(*pages.columns, "reason")


def missing_documents(questions: DataFrame, registry: DataFrame) -> DataFrame:
    """(doc_name, n_questions) of documents that questions (case_id, doc_name, evidence array<struct<doc>>)
    refer to, as their own or in evidence, and that the registry (doc_name) lacks."""
    named = questions.select("case_id", F.explode(F.array_union(F.array("doc_name"), F.coalesce(F.transform("evidence", lambda e: e["doc"]), F.array().cast("array<string>")))).alias("doc_name")).where("doc_name is not null")
    return named.hint("merge").join(registry.select("doc_name").distinct(), "doc_name", "left_anti").groupBy("doc_name").agg(F.count_distinct("case_id").alias("n_questions"))


def trusted_amount(row) -> Column:
    """Whether an amount may enter the fundamentals; ``row`` gives a column by name."""
    base = (row("confidence") == "high") & row("normalized_value").isNotNull() & (row("unit") == "billion_usd") & (row("currency") == "USD") & F.coalesce(row("period_type") != "quarter", F.lit(True)) & row("source").isin(*TRUSTED_SOURCES)
    provider = (F.trim(row("provider")) != "") & (F.trim(row("period")) != "") & ~F.lower(row("period")).isin("annual", "quarter", "ttm", "latest") & row("is_normalized")
    return F.coalesce(base & ((row("source") != "provider_metadata") | provider), F.lit(False))


def extract_amounts(pages: DataFrame, window: int = 220) -> DataFrame:
    """(doc_id, page, metric, raw, value, scale, currency, confidence, period, label_at) of (doc_id,
    page, text): a number near a metric's label, in the same sentence; years, percentages and form
    numbers are passed over; a unit behind the number beats the page's caption."""
    number = re.compile(r"(?<![\d.,])([$€£]?)\s?(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(billion|million|thousand|%)?", re.I)
    labels = [(m, re.compile(re.escape(a) if not a.isascii() else rf"\b{re.escape(a)}\b", re.I)) for m, names in METRIC_LABELS.items() for a in names]
    form = re.compile(r"(?:form|item|note|page)\s*$", re.I)
    year = re.compile(r"\b(?:FY\s*)?(20\d{2})\b")

    def amounts(text: str):
        caption = next((s for s in SCALES if re.search(rf"in {s}s", text, re.I)), None)
        taken = set()
        for metric, label in labels:
            for m in label.finditer(text):
                if any(a <= m.start() < b for a, b in taken):
                    continue
                taken.add(m.span())
                end = re.search(r"[.;](?:\s|$)|\n\n", text[m.end() : m.end() + window])
                stop = m.end() + (end.start() if end else window)
                for n in number.finditer(text, m.end(), min(stop, len(text))):
                    raw, unit = float(n[2].replace(",", "")), (n[3] or "").lower()
                    if unit == "%" or (raw.is_integer() and 2020 <= raw <= 2035 and not unit and not n[1]) or form.search(text[max(0, n.start() - 8) : n.start()]):
                        continue
                    scale = unit or caption
                    near = [(abs(y.start() - n.start()), y[1]) for y in year.finditer(text, max(0, m.start() - window), min(len(text), stop + window))]
                    currency = {"$": "USD", "€": "EUR", "£": "GBP"}.get(n[1], "USD" if re.search(r"\busd\b|\$", text, re.I) else "unknown")
                    yield metric, raw, raw * SCALES[scale] if scale else None, scale or "unit", currency, "high" if unit else "medium" if caption else "low", "FY" + min(near)[1] if near else None, m.start()
                    break

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
    names = ["doc_id", "page", "metric", "raw", "value", "scale", "currency", "confidence", "period", "label_at"]

    def run(batches):
        for batch in batches:
            out = [(d, p, *found) for d, p, t in zip(*(c.to_pylist() for c in batch.columns)) for found in amounts(t or "")]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    rows = pages.select(F.col("doc_id").cast("long"), F.col("page").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, page long, metric string, raw double, value double, scale string, currency string, confidence string, period string, label_at long"
    return rows.mapInArrow(run, schema)


def best_facts(facts: DataFrame) -> DataFrame:
    """Of each (doc_id, page, metric) the fact of the widest scope, then with a total's label, then
    from a table, then the largest; and the next one, if that is of a segment."""
    scope = F.when(F.col("scope") == "consolidated", 2).when(F.col("scope") == "segment", 1).otherwise(0)
    own = Window.partitionBy("doc_id", "page", "metric").orderBy(scope.desc(), F.lower("label").contains("total").cast("int").desc(), (F.col("source") == "html_table").cast("int").desc(), F.abs("value").desc(), "fact_id")
    rows = facts.withColumns({"place": F.row_number().over(own).cast("long"), "best_scope": F.first("scope").over(own)})
    return rows.where("place = 1 or (place = 2 and scope = 'segment' and best_scope = 'consolidated')").drop("best_scope")


def dedupe_across_companies(hits: DataFrame) -> DataFrame:
    """Hits (company, fingerprint, tags array, text, score, rank): a fingerprint that several companies
    have goes to those tagged alone with it, else to the one that its text names, else to the best
    score; then the first of each company and fingerprint. A fingerprint's hits are aggregated, not
    sorted, so very many of them take no more of a task's memory. Of equal ranks any may be first."""
    alone = F.coalesce((F.size("tags") == 1) & (F.element_at("tags", 1) == F.col("company")), F.lit(False))
    unranked = F.col("rank").isNull()
    each = hits.groupBy("company", "fingerprint", alone.alias("alone"), F.contains(F.lower("text"), F.lower("company")).alias("named")).agg(
        F.max("score").alias("score"), F.max(unranked).alias("unranked"), F.min("rank").alias("rank"), F.min_by("score", "rank").alias("ranked"), F.min(F.when(unranked, F.col("score"))).alias("other")
    )  # values of fixed width, so that the groups are hashed
    first = F.struct(F.when(~F.col("unranked"), F.col("rank")).alias("rank"), F.when(F.col("unranked"), F.col("other")).otherwise(F.col("ranked")).alias("score"))
    each = written(each.select("company", "fingerprint", "alone", "named", "score", first.alias("first")), "companies-hits")
    own = F.col("fingerprint").eqNullSafe(F.col("of"))
    best = each.groupBy(F.col("fingerprint").alias("of")).agg(F.max("alone").alias("any_alone"), F.max(F.struct("named", "score")).alias("best"))
    top = each.hint("merge").join(best, own).where(F.struct("named", "score").eqNullSafe(F.col("best")))
    winners = top.groupBy("of", "any_alone").agg(F.min(F.struct("company"))["company"].alias("winner"))
    kept = each.hint("merge").join(winners, own).where("alone or (not any_alone and company = winner)")
    return kept.groupBy("company", "fingerprint").agg(F.min("first").alias("first")).select("company", "fingerprint", "first.score", "first.rank")
