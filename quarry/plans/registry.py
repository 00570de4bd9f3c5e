"""The register of queries: a function (spark, sf_dir) and, where SQL can say the same, a DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable
from textwrap import dedent

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = dedent(sql).strip()
        return f

    return add
