"""JSON payloads, citations and sound numbers, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CITATION = r"^(.+)#p(\d+)$"


def payload(text: Column) -> Column:
    """The text of an answer that begins with its JSON: its first fenced block, or else from its first
    brace to its last; null where no JSON begins there. Of several objects the first counts."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json|JSON)?\s*\n?(.*?)```", 1), F.lit(""))
    braced = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    first = lambda found: F.when(F.try_parse_json(found).isNotNull(), F.trim(found))
    return F.coalesce(first(fenced), first(braced))


def canonical_json(text: Column) -> Column:
    """The JSON that a text begins with, without spaces, its keys sorted at every depth; null without any.
    A variant keeps an object's fields by name, so permuted keys give one text."""
    return F.to_json(F.try_parse_json(text))


def citation(text: Column) -> Column:
    """struct(valid, document, page) of ``document#pN``; a page that no bigint holds isn't valid."""
    page = F.nullif(F.regexp_extract(text, CITATION, 2), F.lit("")).try_cast("long")
    document = F.when(page.isNotNull(), F.regexp_extract(text, CITATION, 1))
    return F.struct(page.isNotNull().alias("valid"), document.alias("document"), page.alias("page"))


def sound(number: Column) -> Column:
    """The number as a double; null for NaN and for infinities."""
    x = number.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def close_to(a: Column, b: Column, relative: float = 0.01, least: float = 1e-9) -> Column:
    """Whether two numbers are within a share of the second, or ``least``; false if one isn't sound."""
    a, b = sound(a), sound(b)
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(least), F.abs(b) * relative), F.lit(False))
