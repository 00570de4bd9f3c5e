"""Table functions for SQL: chunks of pages, rows of HTML tables, findings of hidden instructions.

Each takes a table, reads one column of it and puts its own behind the others, whatever they are:

    SELECT * FROM quarry_page_chunks(TABLE(pages) PARTITION BY doc_id ORDER BY page, size => 900)

Rows pass one at a time, and what is kept from row to row is a count, so a partition may be of any size.
A null text has no rows. A table without the column that is read, or with one of another type, or with
a column named like a new one, is an error when the statement is analyzed.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from quarry.functions.text import INJECTIONS
from quarry.operators.chunking import html_tables

SPACE = " \t\n\r\f\v"
# as the JVM reads these patterns: white space and case are those of ASCII
_FINDINGS = [(code, severity, re.compile(pattern, re.ASCII)) for code, severity, pattern in INJECTIONS]


def _schema(rows: AnalyzeArgument, column: str, added: list[StructField]) -> AnalyzeResult:
    """The table's columns but ``column``, and then those added."""
    if not rows.isTable:
        raise ValueError("the first argument must be a table: TABLE(...)")
    fields = list(rows.dataType.fields)
    if [f.dataType for f in fields if f.name == column] != [StringType()]:
        raise ValueError(f"the table needs one column {column} of strings")
    kept = [f for f in fields if f.name != column]
    clash = {f.name.lower() for f in kept} & {f.name.lower() for f in added}
    if clash:
        raise ValueError(f"the table may not have columns named {sorted(clash)}")
    return AnalyzeResult(StructType([*kept, *added]))


def _apart(row, column: str) -> tuple[tuple, str | None]:
    at = row.__fields__.index(column)
    return (*row[:at], *row[at + 1 :]), row[at]


def _overlap(size: int, overlap: int) -> int:
    return min(overlap, size - 1) if overlap > 0 and size > 1 else 0


def windows_of(text: str, size: int, overlap: int = 0) -> list[str]:
    step = size - _overlap(size, overlap)
    ends = len(text) - _overlap(size, overlap)
    return [text[i : i + size] for i in range(0, max(ends, 1), step)] if text else []


def packed(text: str, size: int) -> list[str]:
    """Paragraphs packed to ``size`` characters; a longer one stands alone."""
    out: list[str] = []
    room = False  # whether the last one may take up more
    for p in filter(None, (x.strip(SPACE) for x in re.split(r"\n{2,}", text))):
        if room and len(out[-1]) + 2 + len(p) <= size:
            out[-1] += "\n\n" + p
        else:
            out.append(p)
            room = len(p) <= size
    return out


def chunks_of(text: str, size: int, overlap: int) -> list[str]:
    overlap, out = _overlap(size, overlap), []
    for part in packed(text, size):
        end = out[-1][-overlap:] if out and overlap else None
        if end is None or part.startswith(end):
            out += windows_of(part, size, overlap)
        else:
            last = out[-1]
            out += [w for w in windows_of(f"{end}\n\n{part}", size, overlap) if w != last]
    return out


@udtf
class PageChunks:
    """quarry_page_chunks(TABLE(text, ...), size, overlap): chunk_no within the row's text, and position
    within the partition, both from 0."""

    def __init__(self):
        self.position = 0

    @staticmethod
    def analyze(pages: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if size is not None and not (isinstance(size.value, int) and size.value > 0):
            raise ValueError("size must be a positive number")
        return _schema(pages, "text", [StructField("position", LongType()), StructField("chunk_no", IntegerType()), StructField("text", StringType())])

    def eval(self, pages, size: int = 900, overlap: int = 120):
        rest, text = _apart(pages, "text")
        for i, chunk in enumerate(chunks_of(text or "", size, overlap)):
            yield *rest, self.position, i, chunk
            self.position += 1


@udtf
class HtmlTables:
    """quarry_html_tables(TABLE(html, ...)): table_no and row_no from 0, and the row's cells."""

    @staticmethod
    def analyze(pages: AnalyzeArgument) -> AnalyzeResult:
        return _schema(pages, "html", [StructField("table_no", IntegerType()), StructField("row_no", IntegerType()), StructField("cells", ArrayType(StringType()))])

    def eval(self, pages):
        rest, html = _apart(pages, "html")
        for t, rows in enumerate(html_tables(html)):
            for r, cells in enumerate(rows):
                yield *rest, t, r, cells


@udtf
class Findings:
    """quarry_injections(TABLE(text, ...)): every match of every pattern, in the patterns' order."""

    @staticmethod
    def analyze(texts: AnalyzeArgument) -> AnalyzeResult:
        return _schema(texts, "text", [StructField(c, StringType()) for c in ("pattern", "severity", "matched")])

    def eval(self, texts):
        rest, text = _apart(texts, "text")
        for code, severity, pattern in _FINDINGS:
            for m in pattern.finditer(text or ""):
                yield *rest, code, severity, m[0].strip(" ")


def register_table_functions(spark: SparkSession) -> None:
    spark.udtf.register("quarry_page_chunks", PageChunks)
    spark.udtf.register("quarry_html_tables", HtmlTables)
    spark.udtf.register("quarry_injections", Findings)
