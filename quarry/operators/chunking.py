"""Documents to pages, paragraphs and chunks."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def windows(text: Column, size: int, overlap: int = 0) -> Column:
    """Windows of ``size`` characters that step by size - overlap; the last one reaches the end."""
    overlap = min(overlap, size - 1) if overlap > 0 and size > 1 else 0
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / step)).cast("int")
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def paginate(docs: DataFrame, size: int = 2800) -> DataFrame:
    """(doc_id, page, text): fixed pages, from 1. An empty text has none."""
    return docs.select("doc_id", F.posexplode(windows(F.coalesce("text", F.lit("")), size)).alias("page", "text")).withColumn("page", (F.col("page") + 1).cast("long"))


def paragraphs(text: Column) -> Column:
    """Trimmed parts between blank lines, or lines if there are none."""
    parts = lambda pattern: F.filter(F.transform(F.split(text, pattern), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: F.length(p) > 0)
    return parts(r"\n{2,}")


def pack(parts: Column, size: int = 900) -> Column:
    """Greedy packing of paragraphs to ``size`` characters, blank lines counted; a longer paragraph
    stands alone. Sequential within a page, parallel over pages."""
    join = lambda a, b: F.when(a == "", b).otherwise(F.concat(a, F.lit("\n\n"), b))
    done = lambda s: F.when(s["buffer"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["buffer"])))

    def step(s, p):
        fits = F.length(join(s["buffer"], p)) <= size
        alone = F.length(p) > size
        return F.struct(
            F.when(fits, join(s["buffer"], p)).when(alone, "").otherwise(p).alias("buffer"),
            F.when(fits, s["out"]).when(alone, F.concat(done(s), F.array(p))).otherwise(done(s)).alias("out"),
        )

    start = F.struct(F.lit("").alias("buffer"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(parts, start, step, done)


def overlapped(packed: Column, size: int = 900, overlap: int = 120) -> Column:
    """Windows over packed paragraphs in which each takes up the end of the one before: the last
    ``overlap`` characters, a blank line, and what is new, cut into windows again. What starts with
    that end already doesn't get it twice, and a piece that equals the one before is left out."""
    overlap = min(overlap, size - 1) if overlap > 0 and size > 1 else 0
    if not overlap:
        return F.flatten(F.transform(packed, lambda c: windows(c, size)))

    def step(out, part):
        last = F.try_element_at(out, F.lit(-1))
        end = F.when(F.length(last) >= overlap, F.substring(last, -overlap, overlap)).otherwise(last)
        shared = last.isNull() | F.coalesce(part.startswith(end), F.lit(False))
        carried = F.filter(windows(F.concat(end, F.lit("\n\n"), part), size, overlap), lambda w: w != last)
        return F.concat(out, F.when(shared, windows(part, size, overlap)).otherwise(carried))

    return F.aggregate(packed, F.array().cast("array<string>"), step)


def chunk_pages(pages: DataFrame, size: int = 900, overlap: int = 120, *carried: str) -> DataFrame:
    """(doc_id, page, chunk_no, chunk_id, text) of (doc_id, page, text), with the ``carried`` columns of
    their page: packed paragraphs with overlap. Every chunk has at most ``size`` characters. Folded a page at a time."""
    cut = overlapped(pack(paragraphs(F.col("text")), size), size, overlap)
    rows = pages.select("doc_id", "page", *carried, F.posexplode(cut).alias("chunk_no", "text"))
    return rows.withColumn("chunk_id", F.format_string("%s:p%d:c%d", F.col("doc_id").cast("string"), "page", "chunk_no"))


def split_markdown(text: Column) -> Column:
    """Sections that start at ``## `` headings, without spaces of any kind around them."""
    return F.filter(F.transform(F.split(text, r"(?m)(?=^##\s+)"), lambda s: F.trim(s, F.lit(SPACES))), lambda s: F.length(s) > 0)


class _Page(HTMLParser):
    """Text with line ends at block tags, without scripts and styles; tables as rows of cells."""

    BLOCKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 section article header footer nav tr table".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.tables: list[list[list[str]]] = []
        self.hidden = 0
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []
        if tag in self.BLOCKS:
            self.text.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        if tag in self.BLOCKS:
            self.text.append("\n")

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)
        elif not self.hidden:
            self.text.append(data)


def _parsed(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def _rows(page: _Page) -> list[list[list[str]]]:
    return [[r for r in t if r] for t in page.tables]


def html_tables(html: str | None) -> list[list[list[str]]]:
    """The tables of one page, as rows of cells; rows without cells are left out."""
    return _rows(_parsed(html))


def parse_html(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, tables) of (page_id, url, html); cell text goes to tables alone. Null
    html has an empty text."""

    def run(batches: Iterator[pa.RecordBatch]):
        tables = pa.list_(pa.list_(pa.list_(pa.string())))
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                text, found = [], []
                for html in part.column(2).to_pylist():
                    page = _parsed(html)
                    lines = (" ".join(line.split()) for line in "".join(page.text).split("\n"))
                    text.append("\n".join(line for line in lines if line))
                    found.append(_rows(page))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(found, tables)], names=["page_id", "url", "text", "tables"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, tables array<array<array<string>>>")
