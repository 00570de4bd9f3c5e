"""Facts from tables: DOM tables, peer tables in lines of text, issuers of documents, number claims.

Positions inside one page decide here, so a page is handled by a small Python function in an Arrow
batch; all before and after it are joins and windows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the behaviour that is matched.
ROW_LABELS = {
    "revenue": r"total revenue|net sales|net revenue|^revenue",
    "gross_margin": r"gross (margin|profit)",
    "operating_income": r"operating income|income from operations",
    "net_income": r"net income|net earnings",
    "r_and_d": r"research and development|r&d",
    "ebitda": r"ebitda",
}
HEADER_LINES = 12


def number_of(cell: str) -> float | None:
    """A cell's number; brackets are a minus, marks of currency and percent are dropped."""
    bare = re.sub(r"[$€£,%\s]", "", cell or "")
    negative = bare.startswith("(") and bare.endswith(")")
    try:
        value = float(bare.strip("()"))
    except ValueError:
        return None
    return -value if negative else value


def _years(row: list[str]) -> list[str]:
    found = (re.search(r"20\d{2}", c or "") for c in row)
    return [m[0] for m in found if m]


def table_facts(pages: DataFrame) -> DataFrame:
    """(page_id, table_no, metric, period, value, scope) of (page_id, tables): the header row's years
    are the periods, a row's label gives its metric, its numbers follow the periods in order."""

    def facts(tables):
        for t, rows in enumerate(tables or ()):
            years = next((y for y in map(_years, rows) if y), [])
            scope = "segment" if any("segment" in (c or "").lower() for row in rows[:2] for c in row) else "consolidated"
            for row in rows:
                label = (row[0] or "").strip().lower() if row else ""
                metric = next((m for m, p in ROW_LABELS.items() if re.search(p, label)), None)
                if metric:
                    numbers = [n for c in row[1:] if (n := number_of(c)) is not None]
                    for period, value in zip(years, numbers):
                        yield t, metric, "FY" + period, value, scope

    def run(batches):
        for batch in batches:
            out = [(p, *f) for p, tables in zip(*(c.to_pylist() for c in batch.columns)) for f in facts(tables)]
            if out:
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["page_id", "table_no", "metric", "period", "value", "scope"])

    return pages.select("page_id", "tables").mapInArrow(run, "page_id long, table_no int, metric string, period string, value double, scope string")


def peer_rows(pages: DataFrame, companies: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, page, row_no, company, metric, value) of (doc_id, page, text), for the companies given or,
    without them, those in each page's ``issuers``: within the first lines a line
    that names two companies or more is the header; of later lines those with as many numbers are
    rows. A vertical table, one company a line and then a metric with one number a line, counts too.
    Fewer than two rows: no table."""

    def rows(text: str, who: list[str]):
        names = {c.lower(): c for c in who}
        lines = [line.strip() for line in text.splitlines() if line.strip()]
        for at, line in enumerate(lines[:HEADER_LINES]):
            found = sorted((m.start(), c) for k, c in names.items() for m in [re.search(rf"(?<!\w){re.escape(k)}(?!\w)", line.lower())] if m)
            if len(found) >= 2:
                out = []
                for row in lines[at + 1 :]:
                    m = re.match(r"([^\d$€£(-]+)(.*)", row)
                    numbers = [n for c in (re.findall(r"\(?-?[$€£]?[\d,]+(?:\.\d+)?\)?%?", m[2]) if m else ()) if (n := number_of(c)) is not None]
                    if m and len(numbers) == len(found):
                        out.append((m[1].strip(" |:"), numbers))
                return [(c, metric, n) for metric, numbers in out for (_, c), n in zip(found, numbers)] if len(out) >= 2 else []
        heads = []
        for at, line in enumerate(lines):
            if line.lower() in names:
                heads.append(names[line.lower()])
                continue
            if len(heads) >= 2:
                out, i = [], at
                while i + len(heads) < len(lines) and number_of(lines[i]) is None:
                    numbers = [number_of(x) for x in lines[i + 1 : i + 1 + len(heads)]]
                    if None in numbers:
                        break
                    out.append((lines[i], numbers))
                    i += 1 + len(heads)
                return [(c, metric, n) for metric, numbers in out for c, n in zip(heads, numbers)] if len(out) >= 2 else []
            heads = []
        return []

    def run(batches):
        for batch in batches:
            out = [(d, p, i, *r) for d, p, t, who in zip(*(c.to_pylist() for c in batch.columns)) for i, r in enumerate(rows(t or "", who or []))]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "page", "row_no", "company", "metric", "value"])

    who = F.col("issuers").cast("array<string>") if companies is None else F.array(*map(F.lit, companies))
    return pages.select(F.col("doc_id").cast("long"), F.col("page").cast("long"), F.col("text").cast("string"), who.alias("issuers")).mapInArrow(run, "doc_id long, page long, row_no int, company string, metric string, value double")


def issuers(candidates: DataFrame) -> DataFrame:
    """(doc_id, issuer, method, confidence) of candidates (doc_id, company, method, n): file name,
    cover form, cover frequency, table header, first mention, in that order."""
    order = (("filename", 0.95), ("cover_form", 0.9), ("cover_frequency", 0.8), ("table_header", 0.7), ("first_mention", 0.5))
    spec = candidates.sparkSession.createDataFrame([(m, i, c) for i, (m, c) in enumerate(order)], "method string, place int, confidence double")
    best = Window.partitionBy("doc_id").orderBy("place", F.desc("n"), "company")
    rows = candidates.join(F.broadcast(spec), "method").withColumn("nth", F.row_number().over(best)).where("nth = 1")
    return rows.select("doc_id", F.col("company").alias("issuer"), "method", "confidence")


def match_in_text(claims: DataFrame, evidence: DataFrame, reach: int = 120) -> DataFrame:
    """(claim_id, evidence_id, matched, reason) of claims (claim_id, company, label, value, period) and
    texts (evidence_id, company, text): the claim's number, in any usual form and unit, near its
    label, in a text that names its year. Pairs share the company and hold the label."""

    def forms(value: float):
        for scale, unit in ((1.0, ""), (1e3, "thousand"), (1e6, "million"), (1e9, "billion")):
            x = value / scale
            if abs(x) >= 0.01:
                for digits in (0, 1, 2):
                    if abs(round(x, digits) - x) <= 0.005 * abs(x):
                        yield f"{x:,.{digits}f}", unit
                        yield f"{x:.{digits}f}", unit

    def check(label, value, period, text):
        low = text.lower()
        at = [m.start() for m in re.finditer(re.escape(label.lower()), low)]
        year = re.search(r"20\d{2}", period or "")
        near = False
        for form, unit in set(forms(value)):
            for m in re.finditer(rf"(?<![\d.,]){re.escape(form)}(?![\d]|[.,]\d)", text):
                if unit and not re.match(rf"\s*{unit}", low[m.end() : m.end() + 12]):
                    continue
                if any(abs(m.start() - a) <= reach for a in at):
                    near = True
        if not near:
            return False, "number_not_found"
        if year and year[0] not in text:
            return False, "period_not_found"
        return True, "text_bound"

    def run(batches):
        for batch in batches:
            out = [(c, e, *check(lb, v, p, t)) for c, lb, v, p, e, t in zip(*(x.to_pylist() for x in batch.columns))]
            if out:
                kinds = (pa.string(), pa.string(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["claim_id", "evidence_id", "matched", "reason"])

    pairs = claims.hint("merge").join(evidence, "company").where(F.lower("text").contains(F.lower("label")))
    return pairs.select("claim_id", "label", F.col("value").cast("double"), "period", "evidence_id", "text").mapInArrow(run, "claim_id string, evidence_id string, matched boolean, reason string")


def export_runs(states: DataFrame) -> dict[str, DataFrame]:
    """Flat tables of nested run states (run_id, companies array, steps array<struct<step,status>>,
    metrics map<company, map<metric, value>>, evidence array<struct<company,citation>>)."""
    return {
        "entities": states.select("run_id", F.posexplode("companies").alias("position", "company")),
        "steps": states.select("run_id", F.posexplode("steps").alias("position", "s")).select("run_id", "position", "s.*"),
        "metrics": states.select("run_id", F.explode("metrics").alias("company", "m")).select("run_id", "company", F.explode("m").alias("metric", "value")),
        "evidence": states.select("run_id", F.posexplode("evidence").alias("position", "e")).select("run_id", "position", "e.*"),
    }
