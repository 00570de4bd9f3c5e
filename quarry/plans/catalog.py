"""All registered queries of the engine, with their DuckDB statements."""

from __future__ import annotations

from quarry.plans import entity_queries, evidence_queries, finance_queries, payload_queries, ranking_queries, report_queries, source_queries, sql_queries, stream_queries, table_queries, text_queries  # noqa: F401
from quarry.plans.registry import QUERIES, SQL


def entry(spark, sf_dir):
    return QUERIES["flagship_bm25_scored"](spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
