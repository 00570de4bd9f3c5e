"""Financial facts in prose, company lines, issuers of files, and approximated earnings."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the behaviour that is matched.
FACT_ALIASES = (
    ("revenue", ("total net sales", "total revenue", "total revenues", "net sales", "revenues", "revenue", "净销售额", "营业收入", "营收", "收入")),
    ("gross_margin", ("gross margin", "gross profit margin", "gross profit", "毛利率")),
    ("operating_margin", ("operating margin", "营业利润率", "经营利润率")),
    ("operating_income", ("operating income", "income from operations", "营业利润", "经营利润")),
    ("net_income", ("net income", "net earnings", "净利润", "净收益")),
    ("eps", ("diluted earnings per share", "earnings per share", "diluted eps", "basic eps", "eps")),
    ("ebitda", ("ebitda",)),
    ("r_and_d", ("research and development", "r&d", "r & d", "研发")),
    ("debt", ("total long-term debt", "long-term debt", "total debt", "长期债务")),
    ("operating_cash_flow", ("cash generated by operating activities", "net cash provided by operating activities", "operating cash flow", "经营活动现金流量")),
    ("capex", ("capital expenditures", "purchases of property, plant and equipment", "capex", "资本开支", "资本支出")),
    ("cash", ("cash and cash equivalents", "现金及现金等价物")),
)
SEGMENT_WORDS = ("segment", "by product", "by category", "geographic", "americas", "greater china", "iphone", "mac ", "ipad", "wearables", "services", "data center", "gaming", "automotive", "reportable segment")
CONSOLIDATED_WORDS = ("consolidated statements of operations", "consolidated statement of operations", "consolidated statements of income", "total net sales", "total revenue", "total revenues")
STATEMENTS = (("income_statement", ("net sales", "revenue", "operating income", "net income", "eps", "gross")), ("cash_flow", ("cash flow", "capital expenditure", "capex")), ("balance_sheet", ("debt", "cash and cash equivalents", "balance sheet")))
MONEY = r"(\$\s?\d{1,3}(?:,\d{3})+(?:\.\d+)?|\$\s?\d+(?:\.\d+)?|\d{1,3}(?:,\d{3})+(?:\.\d+)?)(?:\s*(billion|million|bn|mm|亿|万))?"
YEAR = r"\b(?:fy\s*)?(?:20\d{2})\b"
WINDOW = 220
DEPRECIATION = ("DepreciationDepletionAndAmortization", "DepreciationAndAmortization")


def fact_scope(label: str, page: str) -> tuple[str, str]:
    """(statement, scope) of a fact: consolidated, of a segment, or narrative."""
    head = f"{label} {page[:800]}".lower()
    statement = next((name for name, words in STATEMENTS if any(w in head for w in words)), "narrative")
    if any(w in head for w in CONSOLIDATED_WORDS) or label.startswith("total "):
        return statement, "consolidated"
    if "total" in label:
        return statement, "consolidated"
    return statement, "segment" if any(w in head for w in SEGMENT_WORDS) else "narrative"


def financial_facts(pages: DataFrame) -> DataFrame:
    """(doc_id, page, fact_no, metric, period, value, unit, company, statement, scope, label, source) of
    pages (doc_id, page, text, issuers array): for each alias of a metric its first occurrence with an
    amount in the next 220 characters; revenues that are too small to be a company's are passed over.
    A fact takes the year in its window, or else the page's first. A null page has none. ``best_facts``
    chooses among a metric's."""
    money, year = re.compile(MONEY, re.I), re.compile(YEAR, re.I)
    label_of = lambda m: m[0].upper().replace(" ", "")

    def found(text: str, issuers: list[str]):
        low, first = text.lower(), year.search(text)
        default = label_of(first) if first else "FY"
        for metric, aliases in FACT_ALIASES:
            for alias in aliases:
                at = low.find(alias)
                while at >= 0:
                    window = text[at : at + WINDOW]
                    if amount := money.search(window):
                        value, unit = amount[1].strip("$ ").replace(",", ""), (amount[2] or "").lower()
                        size = float(value)
                        small = metric == "revenue" and ((unit in ("billion", "bn") and size < 50) or (not unit and size < 100))
                        if not small:
                            own = year.search(window)
                            period = label_of(own) if own else default
                            period = "FY" + period if re.fullmatch(r"20\d{2}", period) else period
                            named = [c for c in issuers if c.lower() in window.lower()]
                            company = issuers[0] if len(issuers) == 1 else named[0] if named else issuers[0] if issuers else "Unknown"
                            yield metric, period, value, unit, company, *fact_scope(alias, text), alias, "text_window"
                            break
                    at = low.find(alias, at + len(alias))

    names = ["doc_id", "page", "fact_no", "metric", "period", "value", "unit", "company", "statement", "scope", "label", "source"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 9]

    def run(batches):
        for batch in batches:
            out = [(d, p, i, *fact) for d, p, t, who in zip(*(c.to_pylist() for c in batch.columns)) for i, fact in enumerate(found(t or "", [w for w in who or () if w]))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    rows = pages.select(F.col("doc_id").cast("long"), F.col("page").cast("long"), F.col("text").cast("string"), F.col("issuers").cast("array<string>"))
    return rows.mapInArrow(run, "doc_id long, page long, fact_no int, " + ", ".join(f"{n} string" for n in names[3:]))


def fact_size(value: Column, unit: Column) -> Column:
    """A fact's amount in millions, to compare facts of one metric."""
    return F.abs(value.try_cast("double")) * F.when(unit.isin("billion", "bn"), 1000.0).otherwise(1.0)


def company_lines(lines: DataFrame, aliases: DataFrame) -> DataFrame:
    """Lines (page_id, line_no, line) that are a company's name, in any case, with the company that
    (alias, company) gives them; a line with bars around it counts as well."""
    bare = F.trim(F.regexp_replace(F.trim(F.coalesce("line", F.lit(""))), r"^\|+|\|+$", ""))
    known = aliases.select(F.lower("alias").alias("key"), "company").union(aliases.select(F.lower("company"), "company")).groupBy("key").agg(F.min("company").alias("company"))
    return lines.withColumn("key", F.lower(bare)).where("key <> ''").hint("merge").join(known, "key").select("page_id", "line_no", "company")


def peer_table_rows(lines: DataFrame, aliases: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, company, metric, value) of lines (page_id, line_no, line): under a company's line, lines
    of a metric's label (label, metric) and a number belong to it, up to the next company."""
    named = company_lines(lines, aliases)
    said = F.regexp_extract_all("line", F.lit(r"^\s*\|?\s*([^|\d$]+?)\s*[|:]?\s*\$?(-?\d[\d,]*(?:\.\d+)?)\s*\|?\s*$"), F.lit(1))
    rows = lines.hint("merge").join(named, ["page_id", "line_no"], "left").withColumn("label", F.lower(F.try_element_at(said, F.lit(1))))
    own = Window.partitionBy("page_id").orderBy("line_no")
    rows = rows.withColumn("company", F.last("company", ignorenulls=True).over(own)).where("company is not null and label is not null")
    value = F.replace(F.regexp_extract("line", r"(-?\d[\d,]*(?:\.\d+)?)\s*\|?\s*$", 1), F.lit(","), F.lit("")).try_cast("double")
    return rows.hint("merge").join(labels.select(F.lower("label").alias("label"), "metric"), "label").select("page_id", "company", "metric", value.alias("value"))


def ebitda_approximation(facts: DataFrame) -> DataFrame:
    """(cik, end, ebitda, record_id, note) of company facts (cik, tag, accn, end, val): operating income
    and depreciation of one period, in billions, rounded once; the first of DEPRECIATION that there is.
    A period without both has none. Of repeated facts the largest accession counts."""
    one = facts.where("val is not null").groupBy("cik", "tag", "end").agg(F.max_by(F.struct("val", "accn"), "accn").alias("f"))
    op = one.where("tag = 'OperatingIncomeLoss'").select("cik", "end", F.col("f").alias("op"))
    order = F.array_position(F.array(*map(F.lit, DEPRECIATION)), F.col("tag"))
    depr = one.where(F.col("tag").isin(*DEPRECIATION)).groupBy("cik", "end").agg(F.min_by(F.struct("tag", "f"), order).alias("d"))
    record = lambda tag, accn: F.concat_ws(":", F.lit("sec"), F.col("cik").cast("string"), tag, F.coalesce(accn, F.lit("unknown-accession")), F.col("end").cast("string"))
    rows = op.hint("merge").join(depr, ["cik", "end"])
    ids = F.concat_ws("+", record(F.lit("OperatingIncomeLoss"), F.col("op.accn")), record(F.col("d.tag"), F.col("d.f.accn")))
    return rows.select("cik", "end", F.round((F.col("op.val") + F.col("d.f.val")) / 1e9, 4).alias("ebitda"), ids.alias("record_id"), F.concat(F.lit("approx OperatingIncomeLoss + "), "d.tag").alias("note"))


def research_notes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, title, text) of the .md and .txt files of a folder, at any depth; the title is the first
    heading or line. Blank files have none."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt}").text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    first = F.try_element_at(F.filter(F.split("text", r"\r?\n"), lambda x: F.trim(x) != ""), F.lit(1))
    return files.where(F.trim("text") != "").select("path", F.trim(F.regexp_replace(first, r"^#+\s*", "")).alias("title"), "text")


LEGAL = r"Inc\.?|Corp\.?|Corporation|Ltd\.?|Limited|Co\.?|Company|N\.?V\.?"
HEADER_WORDS = ("metric", "revenue", "ebitda", "指标")


def document_issuers(docs: DataFrame, hints: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, primary, method, confidence, issuers, mentioned) of documents (doc_id, filename, pages
    array), by hints (alias, company) in order of precedence.

    Whom a document is from: the company that its file name has as a word (0.92), or within it (0.85);
    the one that the form's header on the first three pages names (0.9); the one that those pages name
    most often (0.55 and 0.05 a time, legal names threefold, up to 0.88); else the first that it
    mentions (0.4). The name decides against the cover unless that is surer. A short line on the first
    pages that names several companies over figures makes all of them issuers. Without a hit all is
    null or empty."""
    names = [(a.lower(), c) for a, c in hints if a]
    form = re.compile(rf"(?:form\s*10-?k|annual\s+report(?:\s+on\s+form\s*10-?k)?).{{0,120}}?(?:for|of)\s+([A-Z][A-Za-z0-9&.,' \-]{{2,60}}?(?:{LEGAL}))", re.I | re.S)
    legal = re.compile(rf"\b([A-Z][A-Za-z0-9&.,' \-]{{1,50}}?(?:{LEGAL}))\b")
    suffix = re.compile(rf"\b(?:{LEGAL})", re.I)

    def known(raw: str) -> str | None:
        low = raw.strip().rstrip(".,").lower()
        stem = suffix.sub("", low).strip(" ,.")
        return next((c for text in (low, stem) if text for a, c in names if a in text or text in a), None)

    def by_name(filename: str) -> tuple[str, float] | None:
        stem = re.sub(r"\.[A-Za-z0-9]+$", "", filename.lower())
        word = next((c for a, c in names if re.search(rf"(?<![a-z0-9]){re.escape(a)}(?![a-z0-9])", stem)), None)
        part = next((c for a, c in names if len(a) >= 5 and a in stem), None)
        return (word, 0.92) if word else (part, 0.85) if part else None

    def by_cover(cover: str, mentioned: list[str]) -> tuple[str, float, str] | None:
        header = form.search(cover)
        company = header and known(header[1])
        if company:
            return company, 0.9, "form_10k_header"
        low = cover.lower()
        score = {c: sum(low.count(a) for a in {c.lower(), *(a for a, d in names if d == c)}) for c in mentioned}
        for raw in legal.findall(cover):
            if (company := known(raw)) in score:
                score[company] += 3
        best = max(score, key=score.get, default=None)
        return (best, min(0.88, 0.55 + 0.05 * score[best]), "cover_frequency") if best and score[best] else None

    def peers(pages: list[str], mentioned: list[str]) -> list[str]:
        for page in pages[:4]:
            for line in page.splitlines()[:40]:
                low = line.strip().lower()
                there = [c for c in mentioned if c.lower() in low]
                if len(low) <= 120 and len(there) > 1 and any(w in low for w in HEADER_WORDS):
                    return there
        return []

    def resolve(filename: str | None, pages: list[str]):
        filename, pages = filename or "", [p or "" for p in pages]
        text = (filename + "\n" + "\n".join(pages)).lower()
        at = {}
        for a, c in names:
            where = text.find(a)
            if where >= 0:
                at[c] = min(where, at.get(c, where))
        mentioned = sorted(at, key=at.get)
        name, cover, table = by_name(filename), by_cover("\n".join(pages[:3]), mentioned), peers(pages, mentioned)
        if name and (not cover or name[1] >= cover[1]):
            primary, confidence, method = *name, "filename"
        elif cover:
            primary, confidence, method = cover
        elif mentioned:
            primary, confidence, method = mentioned[0], 0.4, "first_mention"
        else:
            return None, "none", 0.0, [], []
        issuers = [primary]
        if table:
            issuers, method, confidence = sorted(table, key=lambda c: c != primary), "peer_table_header", max(confidence, 0.8)
        return primary, method, round(confidence, 3), [c for c in issuers if c in mentioned] or [primary], mentioned

    def run(batches):
        for batch in batches:
            rows = [resolve(f, p or []) for f, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            kinds = (pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["doc_id", "primary", "method", "confidence", "issuers", "mentioned"]) if rows else pa.RecordBatch.from_pylist([], schema=pa.schema([("doc_id", pa.int64()), *zip(("primary", "method", "confidence", "issuers", "mentioned"), kinds)]))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("filename").cast("string"), F.col("pages").cast("array<string>"))
    return rows.mapInArrow(run, "doc_id long, primary string, method string, confidence double, issuers array<string>, mentioned array<string>")
