"""Chunks of whole documents: packed text, rows of peer tables, facts of pages and of DOM tables.

Four streams of rows meet in one order: a page's peer-table rows, or else its packed paragraphs; then the
page's facts; then the facts of the document's tables. Each is made page by page, so a document may
have any number of pages; only its numbering looks at all of its chunks, over range partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.chunking import chunk_pages
from quarry.operators.fact_text import fact_size, financial_facts
from quarry.operators.groups import ranked_in_groups
from quarry.operators.tables import peer_rows
from quarry.session import written

FACT = "struct<metric:string,period:string,value:string,unit:string,company:string,statement:string,scope:string,label:string,source:string>"


def fact_rank(fact: Column) -> Column:
    """What decides between facts of one metric: the wider scope, a total's label, a table, the amount."""
    scope = F.when(fact["scope"] == "consolidated", 3).when(fact["scope"] == "segment", 1).otherwise(0)
    total, html = F.lower(F.coalesce(fact["label"], F.lit(""))).contains("total"), F.coalesce(fact["source"] == "html_table", F.lit(False))
    return F.struct(scope.alias("scope"), total.cast("int").alias("total"), html.cast("int").alias("html"), F.coalesce(fact_size(fact["value"], fact["unit"]), F.lit(0.0)).alias("size"))


def page_facts(pages: DataFrame) -> DataFrame:
    """(doc_id, page, fact_no, fact) of pages (doc_id, page, text, issuers): of each metric on a page the
    fact of the highest rank, the first of equal ones; where that is consolidated, those of segments too."""
    facts = financial_facts(pages).select("doc_id", "page", "fact_no", F.struct("metric", "period", "value", "unit", "company", "statement", "scope", "label", "source").cast(FACT).alias("fact"))
    own = Window.partitionBy("doc_id", "page", "fact.metric").orderBy(fact_rank(F.col("fact")).desc(), "fact_no")
    rows = facts.withColumns({"nth": F.row_number().over(own), "best": F.first("fact.scope").over(own)})
    return rows.where((F.col("nth") == 1) | ((F.col("fact.scope") == "segment") & (F.col("best") == "consolidated"))).drop("nth", "best")


def document_chunks(pages: DataFrame, tables: DataFrame | None = None, size: int = 900, overlap: int = 120) -> DataFrame:
    """(doc_id, position, page, chunk_id, kind, text, companies, chunk_type, char_count, fact) of pages
    (doc_id, page from 1, text, issuers, mentioned) and facts of tables (doc_id, table_no, metric, period,
    value, scope, and label if there is one).

    ``kind`` is text, peer_row, text_fact or table_fact. A page with a peer table gives a chunk for each
    of its figures and no text. Text is tagged with the companies that it names, of the document's
    issuers, or of those mentioned if there are none; if it names none, with all of them. A table's
    fact enters if it outranks the document's last fact of its metric and period, which leaves then;
    of several the first of the highest rank. ``position`` counts a document's chunks from 0. A page
    without text has no chunks; null issuers are none."""
    none = F.array().cast("array<string>")
    some = lambda c: F.filter(F.coalesce(F.col(c).cast("array<string>"), none), lambda x: x != "")
    p = pages.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("long").alias("page"), F.coalesce("text", F.lit("")).alias("text"), some("issuers").alias("issuers"), some("mentioned").alias("mentioned"))
    p = written(p.withColumn("pool", F.when(F.size("issuers") > 0, F.col("issuers")).otherwise(F.col("mentioned"))), "pages")
    own = p.select("doc_id", "page", "pool")

    peers = written(peer_rows(p.select("doc_id", "page", "text", F.col("pool").alias("issuers"))), "peer-rows")
    amount = F.regexp_replace(F.format_string("%.4f", "value"), r"\.?0+$", "")
    row = peers.select("doc_id", "page", F.lit("peer_row").alias("kind"), F.col("row_no").alias("chunk_no"), F.concat("company", F.lit(" "), "metric", F.lit(": "), amount, F.lit(" (peer table).")).alias("text"), F.array("company").alias("companies"))
    plain = p.hint("merge").join(peers.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    packed = chunk_pages(plain.select("doc_id", "page", "text", "pool"), size, overlap, "pool")
    named = F.filter("pool", lambda c: F.contains(F.lower("text"), F.lower(c)))
    text = packed.select("doc_id", "page", F.lit("text").alias("kind"), "chunk_no", "text", F.when(F.size(named) > 0, named).otherwise(F.col("pool")).alias("companies"))
    body = written(row.unionByName(text), "body-chunks")

    facts = page_facts(p.select("doc_id", "page", "text", F.col("pool").alias("issuers")))
    before = body.groupBy("doc_id", "page").agg(F.count("*").alias("before"))
    facts = facts.hint("merge").join(before, ["doc_id", "page"], "left").hint("merge").join(own, ["doc_id", "page"])
    facts = facts.select("doc_id", "page", F.lit("text_fact").alias("kind"), (F.coalesce("before", F.lit(0)) + F.col("fact_no")).cast("int").alias("chunk_no"), "pool", "fact")
    if tables is not None:
        ends = p.groupBy("doc_id").agg(F.max("page").alias("page"), F.max("pool").alias("pool"))
        first = F.try_element_at("pool", F.lit(1))
        lines = tables.hint("merge").join(ends, "doc_id").select(
            "doc_id", "page", F.lit("table_fact").alias("kind"), F.col("table_no").cast("int").alias("chunk_no"), "pool",
            F.struct("metric", "period", F.regexp_replace(F.format_string("%.4f", F.col("value").cast("double")), r"\.?0+$", "").alias("value"), F.lit("").alias("unit"), F.coalesce(first, F.lit("Unknown")).alias("company"), F.lit("table").alias("statement"), "scope", F.col("label" if "label" in tables.columns else "metric").alias("label"), F.lit("html_table").alias("source")).cast(FACT).alias("fact"),
        )
        both = written(facts.unionByName(lines), "facts")
        rank, key = fact_rank(F.col("fact")), [F.col("doc_id"), F.col("fact.metric").alias("metric"), F.col("fact.period").alias("period")]
        of = lambda kind, value, by: F.max_by(F.when(F.col("kind") == kind, value), F.when(F.col("kind") == kind, by))
        at = F.struct("page", "chunk_no")
        picked = both.groupBy(*key).agg(
            of("text_fact", rank, at).alias("last"), F.max(F.when(F.col("kind") == "text_fact", at)).alias("last_at"),
            F.max(F.when(F.col("kind") == "table_fact", F.struct(rank.alias("rank"), (-F.col("chunk_no")).alias("early")))).alias("table"),
        )
        picked = written(picked.where("table is not null").where(F.col("last").isNull() | (F.col("table.rank") > F.col("last"))), "outranked")
        joined = both.withColumns({"metric": F.col("fact.metric"), "period": F.col("fact.period")}).hint("merge").join(picked, ["doc_id", "metric", "period"], "left")
        enters = (F.col("kind") == "table_fact") & F.col("table").isNotNull() & (rank == F.col("table.rank")) & (-F.col("chunk_no") == F.col("table.early"))
        leaves = F.coalesce(at == F.col("last_at"), F.lit(False))
        facts = joined.where(F.when(F.col("kind") == "table_fact", F.coalesce(enters, F.lit(False))).otherwise(~leaves)).select(facts.columns)
    f = F.col("fact")
    said = F.concat(f["company"], F.lit(" "), f["metric"], F.lit(" "), f["period"], F.lit(": "), f["value"], F.when(f["unit"] != "", F.concat(F.lit(" "), f["unit"])).otherwise(""), F.lit(" (filing fact; "), f["scope"], F.lit("; "), f["statement"], F.lit(")."))
    facts = facts.select("doc_id", "page", "kind", "chunk_no", said.alias("text"), F.when(f["company"] == "Unknown", F.col("pool")).otherwise(F.array(f["company"])).alias("companies"), "fact")

    rows = body.withColumn("fact", F.lit(None).cast(FACT)).unionByName(facts)
    last, mark = F.col("kind") == "table_fact", F.when(F.col("kind") == "text_fact", "f").when(F.col("kind") == "table_fact", "t").otherwise("c")
    rows = rows.withColumns({"late": last.cast("int"), "stage": (F.col("kind") == "text_fact").cast("int"), "chunk_id": F.concat(F.col("doc_id").cast("string"), F.lit(":p"), F.col("page").cast("string"), F.lit(":"), mark, F.col("chunk_no").cast("string"))})
    rows = rows.withColumns({"chunk_type": F.when(F.col("kind").isin("text_fact", "table_fact"), "financial_metric").otherwise(T.chunk_type(F.col("text"))), "char_count": F.length("text").cast("long")})
    placed = ranked_in_groups(rows.withColumn("sub", F.coalesce("fact.metric", F.lit(""))), ["doc_id"], ["late", "page", "stage", "chunk_no", "sub"], "position")
    return placed.select("doc_id", "position", "page", "chunk_id", "kind", "text", "companies", "chunk_type", "char_count", "fact")
