"""Fiscal periods: identities of labels, whether they match, and which year a table of files is about."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the behaviour that is matched.
TYPE_WORDS = ("annual", "quarter", "ttm", "latest", "model")
FACT_SOURCES = ("sec_companyfacts", "provider_record", "document_text", "table_header", "structured_table", "filing_fact")
END_SOURCES = ("sec_companyfacts", "yahoo_fundamentals", "upload_text", "upload_filename", "filing_text", "provider_metadata", "document_extracted")
END_WORDS = ("sec", "yahoo", "upload", "filing", "provider", "document")
CONVENTION = "issuer_convention_hint"
QUARTER = r"Q\s*([1-4])\s*(20\d{2})|(20\d{2})\s*Q\s*([1-4])"
FISCAL = r"FY\s*(20\d{2})|FISCAL\s+YEAR\s*(20\d{2})"
DATE = r"20\d{2}-\d{2}-\d{2}"
LABELS = (rf"\b(?:{QUARTER})\b", rf"\b(?:{FISCAL})\b", rf"\b{DATE}\b")


def _part(text: Column, pattern: str, *groups: int) -> Column:
    """The first of the pattern's groups that isn't empty, else null."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, pattern, g), F.lit("")) for g in groups))


def identity(label: Column) -> Column:
    """struct(kind, year, quarter, date) of a label: date, quarter, fiscal_year, calendar_year, or
    unknown. A year in an unknown label is kept, but such a label equals nothing. Null is unknown."""
    up = F.upper(F.trim(F.coalesce(label, F.lit(""))))
    years = F.regexp_extract_all(up, F.lit(r"20\d{2}"), F.lit(0))
    date = F.when(up.rlike(f"^{DATE}$"), up)
    q, q_year = _part(up, rf"\b(?:{QUARTER})\b", 1, 4), _part(up, rf"\b(?:{QUARTER})\b", 2, 3)
    fiscal = _part(up, rf"\b(?:{FISCAL})\b", 1, 2)
    loose_q = F.when(F.size(years) == 1, _part(up, r"\bQ([1-4])\b", 1))
    loose_fiscal = (F.size(years) == 1) & up.rlike(r"\bFY\b|FISCAL")
    kind = (
        F.when(F.lower(up).isin("", *TYPE_WORDS), "unknown")
        .when(date.isNotNull(), "date")
        .when(q.isNotNull(), "quarter")
        .when(fiscal.isNotNull(), "fiscal_year")
        .when(up.rlike(r"^20\d{2}$"), "calendar_year")
        .when(loose_q.isNotNull(), "quarter")
        .when(loose_fiscal, "fiscal_year")
        .otherwise("unknown")
    )
    year = F.when(date.isNotNull(), F.substring(up, 1, 4)).otherwise(F.coalesce(q_year, fiscal, F.try_element_at(years, F.lit(1))))
    quarter = F.when(date.isNotNull(), F.ceil(F.substring(up, 6, 2).cast("int") / 3).cast("int")).otherwise(F.coalesce(q, loose_q).cast("int"))
    return F.struct(kind.alias("kind"), year.cast("int").alias("year"), quarter.alias("quarter"), date.alias("date"))


def compatible(a: Column, b: Column) -> Column:
    """Whether two identities are the same period; two unknown ones are."""
    same = (
        F.when(a["kind"].isin("fiscal_year", "calendar_year"), F.lit(True))
        .when(a["kind"] == "quarter", a["quarter"] == b["quarter"])
        .when(a["kind"] == "date", a["date"] == b["date"])
    )
    either = (a["kind"] == "unknown") | (b["kind"] == "unknown")
    return F.when(either, a["kind"] == b["kind"]).otherwise(F.coalesce((a["kind"] == b["kind"]) & (a["year"] == b["year"]) & same, F.lit(False)))


def labels_in(text: Column) -> Column:
    """The identities of all explicit labels of a text."""
    up = F.upper(F.coalesce(text, F.lit("")))
    return F.transform(F.concat(*(F.regexp_extract_all(up, F.lit(p), F.lit(0)) for p in LABELS)), identity)


def _match(status: str, matched: bool, source: str | None) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(matched).alias("matched"), F.lit(source).cast("string").alias("source"))


def _once(use, **columns: Column) -> Column:
    """``use`` of a struct of the columns, each of which is evaluated, and planned, once."""
    return F.transform(F.array(F.struct(*(c.alias(name) for name, c in columns.items()))), use)[0]


def match(claim: Column, evidence: Column, text: Column) -> Column:
    """struct(status, matched, source): a claim that names no period needs none; labels in the text
    decide before the evidence's own label, and one that conflicts is enough to refuse."""
    own = F.when(~F.lower(F.trim(evidence)).isin(*TYPE_WORDS), F.nullif(F.trim(evidence), F.lit("")))

    def decide(x: Column) -> Column:
        mine, local, theirs = x["mine"], x["local"], x["theirs"]
        return (
            F.when(x["claim"].isNull() | (x["claim"] == "") | ((mine["kind"] == "unknown") & mine["year"].isNull()), _match("not_required", True, None))
            .when(F.exists(local, lambda y: ~compatible(mine, y)), _match("mismatch", False, "text"))
            .when(F.size(local) > 0, _match("text_match", True, "text"))
            .when(x["own"].isNull() | ((theirs["kind"] == "unknown") & theirs["year"].isNull()), _match("unknown", False, None))
            .when(compatible(mine, theirs), _match("exact", True, "evidence.period"))
            .otherwise(_match("mismatch", False, "evidence.period"))
        )

    return _once(decide, claim=claim, mine=identity(claim), local=labels_in(text), own=own, theirs=identity(own))


_EDGE = re.compile(r"[\r\n;|]+|(?<=[.!?])\s+(?=[A-Z一-鿿])")
_LABEL = re.compile("|".join(f"(?:{p})" for p in LABELS))


def labels_around(text: str):
    """The labels of ``labels_nearest`` in one text, and with ``local`` the sentence too, as a function of
    (first, last), which looks at each sentence once."""
    edges = [0, *(p for m in _EDGE.finditer(text) for p in m.span()), len(text)]
    known: dict[tuple[int, int], list[tuple[float, str]]] = {}

    def near(first: int, last: int, local: bool = False):
        a, b = edges[bisect_right(edges, first) - 1], edges[min(bisect_left(edges, last), len(edges) - 1)]
        if (found := known.get((a, b))) is None:
            known.clear()
            found = known[a, b] = [((m.start() + m.end()) / 2 + a, m[0]) for m in _LABEL.finditer(text[a:b].upper())]
        middle = (first + last) / 2
        if len(found) > 1:
            least = min([abs(at - middle) for at, _ in found])
            labels = [label for at, label in found if abs(at - middle) == least]
        else:
            labels = [label for _, label in found]
        return (text[a:b].strip(), labels) if local else labels

    return near


def labels_nearest(text: str, first: int, last: int) -> tuple[str, list[str]]:
    """The sentence or table row around a number, and those of its period labels that lie nearest to the
    number's middle."""
    return labels_around(text)(first, last, True)


def nearest_labels(rows: DataFrame) -> DataFrame:
    """``rows`` (id, text, first, last: of a number) with local and labels as ``labels_nearest`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            near = [labels_nearest(text or "", first, last) for text, first, last in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in near], pa.string()), pa.array([x for _, x in near], pa.list_(pa.string()))], names=["id", "local", "labels"]
            )

    return rows.select(F.col("id").cast("long"), F.col("text").cast("string"), F.col("first").cast("int"), F.col("last").cast("int")).mapInArrow(run, "id long, local string, labels array<string>")


def match_near(claim: Column, labels: Column, fallback: Column) -> Column:
    """struct(status, matched, source) of a claim against the labels nearest to its number, which must
    be one period and agree with the evidence's own; without any the evidence's own decides."""

    def decide(x: Column) -> Column:
        chosen, own = F.try_element_at(x["found"], F.lit(1)), x["own"]
        return (
            F.when(F.size(x["found"]) == 0, x["alone"])
            .when(F.size(x["found"]) > 1, _match("ambiguous", False, "text"))
            .when((own["kind"] != "unknown") & ~compatible(chosen, own), _match("metadata_conflict", False, "text+evidence.period"))
            .when(compatible(x["mine"], chosen), _match("text_match", True, "text"))
            .otherwise(_match("mismatch", False, "text"))
        )

    found = F.array_distinct(F.transform(F.coalesce(labels, F.array().cast("array<string>")), identity))
    return _once(decide, found=found, mine=identity(claim), own=identity(fallback), alone=match(claim, fallback, F.lit("")))


def factual(period: Column, source: Column, alignment: Column) -> Column:
    """Whether a source of facts binds exactly this period."""
    of = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (identity(period)["kind"] != "unknown") & of(source).isin(*FACT_SOURCES) & (of(alignment) == "exact")


def requested_year(*texts: Column) -> Column:
    """The last year that is marked FY, or else the last year, of the first text that has one."""
    last = lambda t, p: F.try_element_at(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(p), F.lit(1)), F.lit(-1))
    return F.coalesce(*(F.coalesce(last(t, r"(?i)FY\s*(20\d{2})"), last(t, r"(20\d{2})")) for t in texts)).cast("int")


def annotate_year(meta_year: Column, filename: Column, text: Column, requested: Column) -> Column:
    """struct(fiscal_year, source, alignment): the year that the data name, or that the file's name
    (without its folders) or the first 8,000 characters of its text name, or else the one asked for,
    which is then only assumed."""
    by_name = requested_year(F.regexp_extract(F.coalesce(filename, F.lit("")), r"([^/\\]*)$", 1))
    by_text = requested_year(F.substring(F.coalesce(text, F.lit("")), 1, 8000))
    found, source = F.coalesce(by_name, by_text), F.when(by_name.isNotNull(), "upload_filename").when(by_text.isNotNull(), "upload_text")
    against = lambda year, label: F.when(requested.isNull(), label).when(year == requested, "exact").otherwise("fallback_latest")
    alignment = (
        F.when(meta_year.isNotNull(), against(meta_year, F.lit("upload_labeled")))
        .when(found.isNotNull(), against(found, source))
        .when(requested.isNotNull(), "assumed_from_query")
        .otherwise("unspecified")
    )
    year = F.coalesce(meta_year, found, requested)
    return F.struct(year.alias("fiscal_year"), F.when(meta_year.isNull(), F.coalesce(source, F.when(requested.isNotNull(), "query"))).alias("source"), alignment.alias("alignment"))


def used_year(fiscal_year: Column, fy: Column, period: Column) -> Column:
    """The year that the data carry, or that their period names."""
    return F.coalesce(fiscal_year.try_cast("int"), fy.try_cast("int"), F.nullif(F.regexp_extract(F.coalesce(period, F.lit("")), r"(20\d{2})", 1), F.lit("")).cast("int"))


def period_end(source: Column, end: Column, period: Column) -> Column:
    """The date in the period's end, or in the period, if a source of facts gives it."""
    named = F.trim(F.coalesce(source, F.lit("")))
    fact = (named != "") & (named != CONVENTION) & (named.isin(*END_SOURCES) | F.exists(F.array(*map(F.lit, END_WORDS)), lambda w: named.contains(w)))
    date = lambda c: F.nullif(F.regexp_extract(F.replace(F.coalesce(c, F.lit("")), F.lit("/"), F.lit("-")), f"({DATE})", 1), F.lit(""))
    return F.when(fact, F.coalesce(date(end), date(period)))
