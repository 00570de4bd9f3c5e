"""Queries of table facts, peer tables, issuers, text claims and run exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import number_spans as N
from quarry.operators import tables as B
from quarry.operators.chunking import parse_html
from quarry.plans.registry import query
from quarry.plans.standins import FACTS, facts
from quarry.session import table


def _statement(spark, sf_dir):
    """A page of HTML per supplier, with a table of its figures."""
    f = facts(spark, sf_dir).where("fy in (2000, 2001)").withColumn("whole", F.round("value", 0).cast("long"))
    label = F.when(F.col("metric") == "revenue", "Total revenue").when(F.col("metric") == "ebitda", "EBITDA").otherwise("Operating income")
    row = f.groupBy("company", label.alias("label")).agg(F.max(F.when(F.col("fy") == 2001, F.col("whole"))).alias("a"), F.max(F.when(F.col("fy") == 2000, F.col("whole"))).alias("b")).where("a is not null and b is not null")
    line = F.concat(F.lit("<tr><td>"), "label", F.lit("</td><td>$"), F.format_number("a", 0), F.lit("</td><td>"), F.format_number("b", 0), F.lit("</td></tr>"))
    per = row.groupBy("company").agg(F.array_join(F.array_sort(F.collect_list(line)), "").alias("rows"))
    html = F.concat(F.lit("<p>Annual figures</p><table><tr><th></th><th>FY2001</th><th>FY2000</th></tr>"), "rows", F.lit("</table>"))
    return per.select(F.substring("company", 10, 20).cast("long").alias("page_id"), F.col("company").alias("url"), html.alias("html"))


@query(f"""WITH {FACTS}, f AS (SELECT CAST(substr(company, 10) AS BIGINT) AS page_id, metric, fy, round(value, 0) AS value FROM facts WHERE fy IN (2000, 2001)), b AS (SELECT page_id, metric FROM f GROUP BY 1, 2 HAVING count(*) = 2)
SELECT page_id, metric, 'FY' || fy AS period, value, 'consolidated' AS scope FROM f JOIN b USING (page_id, metric)""")
def txt19_table_facts(spark, sf_dir):
    return B.table_facts(parse_html(_statement(spark, sf_dir))).select("page_id", "metric", "period", "value", "scope")


@query(f"""WITH {FACTS}, f AS (SELECT metric, fy, company, round(value, 0) AS value FROM facts WHERE company IN ('Supplier#000000001', 'Supplier#000000002')), n AS (SELECT fy, metric FROM f GROUP BY 1, 2 HAVING count(*) = 2), r AS (SELECT fy FROM n GROUP BY 1 HAVING count(*) >= 2)
SELECT fy AS doc_id, CASE company WHEN 'Supplier#000000001' THEN 'Alpha' ELSE 'Beta' END AS company, metric, value FROM f JOIN n USING (fy, metric) JOIN r USING (fy)""")
def txt16_peer_rows(spark, sf_dir):
    f = facts(spark, sf_dir).where("company in ('Supplier#000000001', 'Supplier#000000002')").withColumn("whole", F.round("value", 0).cast("long"))
    one = lambda c: F.max(F.when(F.col("company") == c, F.col("whole")))
    rows = f.groupBy("fy", "metric").agg(one("Supplier#000000001").alias("a"), one("Supplier#000000002").alias("b")).where("a is not null and b is not null")
    line = F.concat(F.col("metric"), F.lit("  $"), F.format_number("a", 0), F.lit("  "), F.format_number("b", 0))
    pages = rows.groupBy(F.col("fy").alias("doc_id")).agg(F.concat(F.lit("Peers\nMetric  Alpha  Beta\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("text"))
    return B.peer_rows(pages.withColumn("page", F.lit(1)), ("Alpha", "Beta")).select("doc_id", "company", "metric", "value")


@query(f"""WITH {FACTS}, f AS (SELECT metric, fy, company, round(value, 0) AS value FROM facts WHERE company IN ('Supplier#000000001', 'Supplier#000000002')), n AS (SELECT fy, metric FROM f GROUP BY 1, 2 HAVING count(*) = 2), r AS (SELECT fy FROM n GROUP BY 1 HAVING count(*) >= 2)
SELECT fy AS doc_id, CASE company WHEN 'Supplier#000000001' THEN 'Alpha' ELSE 'Beta' END AS company, metric, value FROM f JOIN n USING (fy, metric) JOIN r USING (fy)""")
def txt27_vertical_peers(spark, sf_dir):
    f = facts(spark, sf_dir).where("company in ('Supplier#000000001', 'Supplier#000000002')").withColumn("whole", F.round("value", 0).cast("long"))
    one = lambda c: F.max(F.when(F.col("company") == c, F.col("whole")))
    rows = f.groupBy("fy", "metric").agg(one("Supplier#000000001").alias("a"), one("Supplier#000000002").alias("b")).where("a is not null and b is not null")
    part = F.concat_ws("\n", "metric", F.format_number("a", 0), F.format_number("b", 0))
    pages = rows.groupBy(F.col("fy").alias("doc_id")).agg(F.concat(F.lit("Alpha\nBeta\n"), F.array_join(F.array_sort(F.collect_list(part)), "\n")).alias("text"))
    return B.peer_rows(pages.withColumn("page", F.lit(1)), ("Alpha", "Beta")).select("doc_id", "company", "metric", "value")


PEERS = FACTS + """, f AS (SELECT CAST(substr(company, 10) AS BIGINT) AS n, company, metric, fy, round(value, 0) AS value FROM facts), p AS (SELECT n * 10000 + fy AS doc_id, company, metric, value FROM f UNION ALL SELECT (n - 1) * 10000 + fy, company, metric, value FROM f),
m AS (SELECT doc_id, metric FROM p GROUP BY 1, 2 HAVING count(*) = 2), r AS (SELECT doc_id FROM m GROUP BY 1 HAVING count(*) >= 2)"""


def _peers(spark, sf_dir):
    """(doc_id, metric, a, b) of each pair of neighbouring suppliers (0 and 1, 1 and 2, ...) and year."""
    f = facts(spark, sf_dir).select("fy", "metric", F.substring("company", 10, 20).cast("long").alias("n"), F.round("value", 0).cast("long").alias("whole"))
    f = f.withColumn("place", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("doc_id", (F.col("n") - F.col("place")) * 10000 + F.col("fy"))
    one = lambda place: F.max(F.when(F.col("place") == place, F.col("whole")))
    return f.groupBy("doc_id", "metric").agg(one(0).alias("a"), one(1).alias("b")).where("a is not null and b is not null")


def _of_suppliers(pages):
    """The rows of the pages, with the suppliers' names instead of their places in the pair."""
    rows = B.peer_rows(pages.withColumn("page", F.lit(1)), ("Alpha", "Beta"))
    n = F.floor(F.col("doc_id") / 10000) + F.when(F.col("company") == "Alpha", 0).otherwise(1)
    return rows.select("doc_id", F.format_string("Supplier#%09d", n).alias("company"), "metric", "value")


@query(f"WITH {PEERS} SELECT doc_id, company, metric, value FROM p JOIN m USING (doc_id, metric) JOIN r USING (doc_id)")
def txt16_all_peer_rows(spark, sf_dir):
    line = F.concat(F.col("metric"), F.lit("  $"), F.format_number("a", 0), F.lit("  "), F.format_number("b", 0))
    return _of_suppliers(_peers(spark, sf_dir).groupBy("doc_id").agg(F.concat(F.lit("Peers\nMetric  Alpha  Beta\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("text")))


@query(f"WITH {PEERS} SELECT doc_id, company, metric, value FROM p JOIN m USING (doc_id, metric) JOIN r USING (doc_id)")
def txt27_all_vertical_peers(spark, sf_dir):
    part = F.concat_ws("\n", "metric", F.format_number("a", 0), F.format_number("b", 0))
    return _of_suppliers(_peers(spark, sf_dir).groupBy("doc_id").agg(F.concat(F.lit("Alpha\nBeta\n"), F.array_join(F.array_sort(F.collect_list(part)), "\n")).alias("text")))


@query("""WITH c AS (SELECT doc_id, source AS company, 'cover_frequency' AS method, n_chars AS n FROM documents WHERE doc_id % 3 > 0 UNION ALL SELECT doc_id, lang, 'filename', 1 FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'first', 'first_mention', 9 FROM documents),
s(method, place, confidence) AS (VALUES ('filename', 0, 0.95), ('cover_form', 1, 0.9), ('cover_frequency', 2, 0.8), ('table_header', 3, 0.7), ('first_mention', 4, 0.5))
SELECT doc_id, company AS issuer, method, confidence::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place, n DESC, company) AS nth FROM c JOIN s USING (method)) WHERE nth = 1""")
def txt23_issuers(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    part = lambda rows, company, method, n: rows.select("doc_id", company.alias("company"), F.lit(method).alias("method"), n.cast("long").alias("n"))
    c = part(d.where("doc_id % 3 > 0"), F.col("source"), "cover_frequency", F.col("n_chars")).unionByName(part(d.where("doc_id % 5 = 0"), F.col("lang"), "filename", F.lit(1))).unionByName(part(d, F.lit("first"), "first_mention", F.lit(9)))
    return B.issuers(c)


@query(f"""WITH {FACTS}, f AS (SELECT company, fy, round(value, 0) AS value FROM facts WHERE metric = 'revenue' AND fy >= 2000) SELECT company || ':' || fy AS claim_id, company AS evidence_id, fy = 2001 AS matched, CASE WHEN fy = 2001 THEN 'text_bound' ELSE 'number_not_found' END AS reason FROM f WHERE company IN (SELECT company FROM f WHERE fy = 2001)""")
def clm05_text_match(spark, sf_dir):
    f = facts(spark, sf_dir).where("metric = 'revenue' and fy >= 2000").withColumn("value", F.round("value", 0))
    claims = f.select(F.concat_ws(":", "company", F.col("fy").cast("string")).alias("claim_id"), "company", F.lit("total revenue").alias("label"), "value", F.concat(F.lit("FY"), F.col("fy").cast("string")).alias("period"))
    text = F.concat(F.lit("In fiscal 2001 total revenue was $"), F.format_number(F.col("value").cast("long"), 0), F.lit("."))
    evidence = f.where("fy = 2001").select(F.col("company").alias("evidence_id"), "company", text.alias("text"))
    return B.match_in_text(claims, evidence)


STORY = "'The story of order ' || k || ' goes on.'"
SALES = "'Total net sales were $' || (3000 + k % 1000) || ' million in FY2024.'"


@query(f"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders),
r AS (SELECT k, 0 AS late, 1 AS page, 0 AS stage, i.range AS no, 'peer_row' AS kind, 'c' AS mark, CASE i.range % 2 WHEN 0 THEN 'Alpha' ELSE 'Beta' END AS who,
    CASE i.range WHEN 0 THEN 'Alpha units: ' || (c + 10) WHEN 1 THEN 'Beta units: ' || (k + 10) WHEN 2 THEN 'Alpha stores: ' || (c % 90 + 10) ELSE 'Beta stores: ' || (c % 80 + 10) END || ' (peer table).' AS text FROM o, range(4) i
  UNION ALL SELECT k, 0, 2, 0, 0, 'text', 'c', 'Alpha,Beta', {STORY} FROM o WHERE k % 2 = 0
  UNION ALL SELECT k, 0, 3, 0, 0, 'text', 'c', 'Alpha,Beta', {SALES} FROM o WHERE k % 3 = 0
  UNION ALL SELECT k, 0, 3, 1, 1, 'text_fact', 'f', 'Alpha', 'Alpha revenue FY2024: ' || (3000 + k % 1000) || ' million (filing fact; consolidated; income_statement).' FROM o WHERE k % 3 = 0 AND k % 6 <> 0
  UNION ALL SELECT k, 1, 3, 0, 7, 'table_fact', 't', 'Alpha', 'Alpha revenue FY2024: 900000 (filing fact; consolidated; table).' FROM o WHERE k % 6 = 0
  UNION ALL SELECT k, 1, 3, 0, 8, 'table_fact', 't', 'Alpha', 'Alpha revenue FY2023: 55.5 (filing fact; segment; table).' FROM o WHERE k % 6 = 3)
SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY late, page, stage, no) - 1 AS position, page, k || ':p' || page || ':' || mark || no AS chunk_id, kind, text, who AS companies, CASE WHEN mark = 'c' THEN 'narrative' ELSE 'financial_metric' END AS chunk_type FROM r""")
def txt21_composed_chunks(spark, sf_dir):
    """A document of each order: a peer table, a story, sales; and a table's fact that stands for theirs or joins them."""
    from quarry.operators.document_chunks import document_chunks

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    peers = text("Peers\nMetric  Alpha  Beta\nunits  ", c + 10, "  ", k + 10, "\nstores  ", c % 90 + 10, "  ", c % 80 + 10)
    o = table(spark, sf_dir, "orders")
    pages = F.array(peers, F.when(k % 2 == 0, text("The story of order ", k, " goes on.")), F.when(k % 3 == 0, text("Total net sales were $", 3000 + k % 1000, " million in FY2024.")))
    pages = o.select(k.alias("doc_id"), F.posexplode(pages).alias("page", "text")).withColumns({"page": F.col("page") + 1, "issuers": F.array(F.lit("Alpha"), F.lit("Beta")), "mentioned": F.lit(None).cast("array<string>")})
    fact = lambda no, period, value, scope: F.struct(F.lit(no).alias("table_no"), F.lit("revenue").alias("metric"), F.lit(period).alias("period"), F.lit(value).alias("value"), F.lit(scope).alias("scope"), F.lit("Total net sales").alias("label"))
    tables = o.where(k % 3 == 0).select(k.alias("doc_id"), F.when(k % 6 == 0, fact(7, "FY2024", 900000.0, "consolidated")).otherwise(fact(8, "FY2023", 55.5, "segment")).alias("f")).select("doc_id", "f.*")
    return document_chunks(pages, tables).select("doc_id", "position", "page", "chunk_id", "kind", "text", F.array_join("companies", ",").alias("companies"), "chunk_type")


@query("""WITH o AS (SELECT o_orderkey AS k, 12 + (o_orderkey % 800) / 10.0::DOUBLE AS v FROM orders)
SELECT CAST(k AS VARCHAR) AS claim_id, CASE WHEN k % 7 <> 2 THEN 'e' || k END AS evidence_id, k % 7 < 2 AS matched,
  CASE k % 7 WHEN 2 THEN 'number_not_found' WHEN 3 THEN 'metric_label_mismatch' WHEN 4 THEN 'period_mismatch' WHEN 5 THEN 'unit_ambiguous' WHEN 6 THEN 'period_unknown' ELSE 'bound' END AS reason,
  CASE WHEN k % 7 = 2 THEN NULL ELSE round(v, 1) END AS matched_value, CASE WHEN k % 7 = 1 THEN 'million_to_billion' END AS unit_conversion,
  CASE WHEN k % 7 < 2 THEN 'high' WHEN k % 7 = 5 THEN 'low' ELSE 'none' END AS confidence FROM o""")
def clm05_number_spans(spark, sf_dir):
    """A claim on the revenue of each order, and a text on it with one fault, or none."""
    k, v = F.col("o_orderkey"), F.format_number(F.lit(12) + (F.col("o_orderkey") % 800) / 10.0, 1)
    millions = F.format_number((F.lit(120) + F.col("o_orderkey") % 800) * 100, 0)
    say = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    texts = [say("FY2001 net sales were $", v, " billion."), say("Revenue for FY2001 was ", millions, " million dollars."), say("FY2001 revenue was $99999 billion."), say("FY2001 headcount was worth $", v, " billion."), say("FY2000 revenue was $", v, " billion."), say("FY2001 revenue was ", v, "."), say("Revenue was $", v, " billion.")]
    text = F.array(*texts)[(k % 7).cast("int")]
    o = table(spark, sf_dir, "orders")
    evidence = o.select(F.concat(F.lit("e"), k.cast("string")).alias("evidence_id"), k.alias("company"), text.alias("text"), F.lit(None).cast("string").alias("period"))
    claims = o.select(k.alias("claim_id"), k.alias("company"), F.lit("revenue").alias("metric"), (F.lit(12) + (k % 800) / 10.0).alias("value"), F.lit("billion_usd").alias("unit"), F.lit("FY2001").alias("period"))
    return N.match_numbers(claims, evidence).withColumn("matched_value", F.round("matched_value", 1)).drop("start")


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders)
SELECT CAST(k AS VARCHAR) AS claim_id, CASE WHEN k % 5 <> 4 THEN 'e' || k END AS evidence_id, k % 5 = 0 AS matched,
  CASE k % 5 WHEN 0 THEN 'formula_inputs_bound' WHEN 2 THEN 'formula_input_period_mismatch' WHEN 3 THEN 'metric_label_mismatch' ELSE 'formula_input_incomplete' END AS reason FROM o""")
def clm05_formula_inputs(spark, sf_dir):
    """A margin of each order from two amounts; a text has both, one, none, or one of another year or line."""
    k = F.col("o_orderkey")
    a, b = F.lit(20) + (k % 300) / 10.0, F.lit(60) + (k % 300) / 10.0
    say = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    first, second = F.format_number(a, 1), F.format_number(b, 1)
    income = say("FY2001 operating income was $", first, " billion.")
    texts = [say(income, " FY2001 revenue was $", second, " billion."), income, say(income, " FY2000 revenue was $", second, " billion."), say(income, F.lit(" " * 120), " FY2001 headcount was worth $", second, " billion."), F.lit("Nothing was said.")]
    o = table(spark, sf_dir, "orders")
    evidence = o.select(F.concat(F.lit("e"), k.cast("string")).alias("evidence_id"), k.alias("company"), F.array(*texts)[(k % 5).cast("int")].alias("text"), F.lit(None).cast("string").alias("period"))
    claims = o.select(k.alias("claim_id"), k.alias("company"), F.create_map(F.lit("operating_income"), a, F.lit("revenue"), b).alias("inputs"), F.lit("FY2001").alias("period"))
    return N.match_formulas(claims, evidence)


@query("SELECT conv_id AS run_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS position, role AS step, CASE WHEN length(text) > 200 THEN 'ok' ELSE 'short' END AS status FROM conversations")
def src23_run_steps(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    step = F.struct("turn", F.struct(F.col("role").alias("step"), F.when(F.length("text") > 200, "ok").otherwise("short").alias("status")).alias("s"))
    states = c.groupBy(F.col("conv_id").alias("run_id")).agg(F.transform(F.array_sort(F.collect_list(step)), lambda x: x["s"]).alias("steps"))
    none = F.array().cast("array<string>")
    states = states.withColumns({"companies": none, "metrics": F.create_map().cast("map<string,map<string,double>>"), "evidence": F.array().cast("array<struct<company:string,citation:string>>")})
    return B.export_runs(states)["steps"]


@query("""SELECT doc_id, company, alias_count FROM (SELECT doc_id, 'The Group' AS company, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x = 'the')) AS alias_count FROM documents) WHERE alias_count >= 50""")
def jon25_cover_counts(spark, sf_dir):
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: x == "the")
    return table(spark, sf_dir, "documents").select("doc_id", F.lit("The Group").alias("company"), F.size(words).cast("long").alias("alias_count")).where("alias_count >= 50")


@query("""SELECT DISTINCT doc_id, unnest(list_filter(string_split(text, ' '), lambda x: regexp_matches(x, '^[A-Z]{2,5}$') AND x NOT IN ('SS', 'DE', 'LA'))) AS ticker FROM documents""")
def jon10_company_universe(spark, sf_dir):
    found = F.filter(F.split("text", " "), lambda x: x.rlike("^[A-Z]{2,5}$") & ~x.isin("SS", "DE", "LA"))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("ticker")).distinct()


@query("""WITH h AS (SELECT l_orderkey AS case_id, l_linenumber AS rank, 'd' || l_suppkey % 40 || '#p' || l_linenumber AS citation, l_quantity > 40 AS gold FROM lineitem)
SELECT case_id, round(count(CASE WHEN regexp_matches(citation, '^.+#p[1-5]$') THEN 1 END) / count(*), 4) AS coverage, round(coalesce(count(DISTINCT CASE WHEN gold AND rank <= 3 THEN citation END) / nullif(count(DISTINCT CASE WHEN gold THEN citation END), 0), 1.0), 4) AS recall FROM h GROUP BY 1""")
def txt28_citation_coverage(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    h = li.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("rank"), F.concat(F.lit("d"), (F.col("l_suppkey") % 40).cast("string"), F.lit("#p"), F.col("l_linenumber").cast("string")).alias("citation"), (F.col("l_quantity") > 40).alias("gold"))
    found = F.count_distinct(F.when(F.col("gold") & (F.col("rank") <= 3), F.col("citation")))
    every = F.count_distinct(F.when(F.col("gold"), F.col("citation")))
    return h.groupBy("case_id").agg(F.round(F.count_if(F.col("citation").rlike(r"^.+#p[1-5]$")) / F.count("*"), 4).alias("coverage"), F.round(F.coalesce(F.try_divide(found, every), F.lit(1.0)), 4).alias("recall"))


@query("SELECT item_id, 'query' AS source, len(regexp_extract_all(text, '[A-Z]')) AS n_capitals FROM benchmark WHERE length(text) BETWEEN 40 AND 400 AND NOT contains(text, chr(65533))")
def flt08_plausible_labels(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.where(F.length("text").between(40, 400) & ~F.contains("text", F.lit("�"))).select("item_id", F.lit("query").alias("source"), F.size(F.regexp_extract_all("text", F.lit("[A-Z]"), F.lit(0))).cast("long").alias("n_capitals"))


@query(f"WITH {FACTS} SELECT company, metric, fy FROM facts WHERE metric IN ('revenue', 'ebitda') AND NOT (value < 400000) AND fy <> 1998")
def flt10_brief_claims(spark, sf_dir):
    f = facts(spark, sf_dir).select("company", "metric", "fy", F.when(F.col("metric") == "operating_income", "risk").otherwise("numeric").alias("claim_type"), (F.col("value") < 400000).alias("low_signal"))
    return f.where(F.col("claim_type").isin("numeric", "growth") & ~F.col("low_signal") & (F.col("fy") != 1998)).select("company", "metric", "fy")
