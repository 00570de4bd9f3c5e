"""Reports on runs: manifests, shards, leaks, answer arms, alignment, sources, company bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import number_matches, numbers
from quarry.operators.groups import ordered_digests

# Fixed values of the behaviour that is matched.
LEAKS = ("numeric_match", "unsupported_match", "retrieval_pool_miss", "ranking_top10_miss", "evidence_gap_unselected_chunk", "evidence_gap_number_absent", "generation_abstain", "generation_miss")
SCOPE_WORDS = {"uploaded": ("uploaded", "upload", "use_uploaded", "documents", "doc", "file"), "query": ("query", "use_query", "asked", "question"), "both": ("both", "use_both", "all", "union")}
DISCLAIMERS = (r"风险免责声明", r"(?i)(?:^|\n)\s*\**Disclaimer\**?\s*:", r"(?i)not investment advice", r"(?i)does not constitute investment advice")
PROVENANCE = (r"数据来源", r"(?i)data sources?", r"(?i)methodology.*data", r"(?i)uploaded documents?:", r"(?i)structured_source")
UPLOAD_ONLY = ("uploaded note only", "uploaded file only", "uploaded materials only", "uploaded table only", "only the uploaded", "only uploaded", "using only the uploaded", "use only the uploaded", "only from upload", "only use upload", "upload only", "uploads only", "do not use external", "don't use external", "no external data", "without external", "仅用上传", "只用上传", "仅基于上传", "只基于上传", "不要用外部", "不要外部数据", "勿用外部")
DIMENSIONS = (
    ("profitability", ("profit", "margin", "ebitda", "盈利", "利润", "毛利", "净利")),
    ("liquidity", ("liquidity", "cash", "现金", "流动性")),
    ("solvency", ("debt", "leverage", "solvency", "负债", "偿债", "杠杆")),
    ("r_and_d", ("r&d", "research", "研发", "创新")),
    ("supply_chain", ("supply", "supplier", "供应链", "供应商")),
    ("sentiment", ("sentiment", "tone", "management", "管理层", "语气", "措辞")),
    ("compliance", ("compliance", "audit", "risk disclosure", "合规", "审计", "披露")),
    ("market", ("market", "valuation", "price", "行情", "估值", "股价")),
)


def exact_fingerprint(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """(by, n_ids, fingerprint): sha256 of the sorted distinct ids joined by newlines."""
    return ordered_digests(rows, list(by), column)


def split_manifest(cases: DataFrame) -> DataFrame:
    """(role, n_cases, n_companies, case_sha256, company_sha256) of cases (role, case_id, company)."""
    a = exact_fingerprint(cases, "case_id", "role").select("role", F.col("n_ids").alias("n_cases"), F.col("fingerprint").alias("case_sha256"))
    b = exact_fingerprint(cases, "company", "role").select("role", F.col("n_ids").alias("n_companies"), F.col("fingerprint").alias("company_sha256"))
    return a.join(b, "role")


def shared_companies(cases: DataFrame) -> DataFrame:
    """(company, roles) of companies that are in more than one role: none, if a split is disjoint."""
    return cases.groupBy("company").agg(F.array_sort(F.collect_set("role")).alias("roles")).where(F.size("roles") > 1)


def manifest_faults(actual: DataFrame, frozen: DataFrame) -> DataFrame:
    """(role, field, actual, frozen) wherever a manifest differs from the frozen one, missing roles too."""
    fields = [c for c in actual.columns if c != "role"]
    a = actual.select("role", *(F.col(c).cast("string").alias("a_" + c) for c in fields))
    b = frozen.select("role", *(F.col(c).cast("string").alias("b_" + c) for c in fields))
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col("a_" + c).alias("actual"), F.col("b_" + c).alias("frozen")) for c in fields))
    return a.join(b, "role", "full").select("role", F.inline(F.filter(pairs, lambda p: ~p["actual"].eqNullSafe(p["frozen"]))))


def shard_totals(shards: DataFrame, results: DataFrame) -> DataFrame:
    """(run_id, n_shards, n_queries, n_hits, one_identity, disjoint) of shards (run_id, shard, identity,
    n_queries, n_hits) and their results (run_id, shard, query_id): whether all shards ran the same
    thing, and whether no query is in two shards or missing from its shard's count."""
    # a query is in few shards, so it is counted by itself before the run is
    per_query = results.groupBy("run_id", "query_id").agg(F.count_distinct("shard").alias("n")).groupBy("run_id").agg(F.count("*").alias("distinct"), F.max("n").alias("most"))
    totals = shards.groupBy("run_id").agg(F.count("*").alias("n_shards"), F.sum("n_queries").alias("n_queries"), F.sum("n_hits").alias("n_hits"), (F.min("identity") == F.max("identity")).alias("one_identity"))
    ok = F.coalesce((F.col("most") == 1) & (F.col("distinct") == F.col("n_queries")), F.col("n_queries") == 0)
    return totals.join(per_query, "run_id", "left").select("run_id", "n_shards", "n_queries", "n_hits", "one_identity", ok.alias("disjoint"))


def recoverability(cases: DataFrame, packs: DataFrame) -> DataFrame:
    """(strategy, n_cases, n_recovered): for how many cases (case_id, gold) the gold number stands in the
    text that a packing strategy gives (case_id, strategy, text); all strategies keep a row."""
    rows = packs.hint("merge").join(cases, "case_id")
    hit = number_matches(numbers(F.coalesce("text", F.lit(""))), F.col("gold"))
    return rows.groupBy("strategy").agg(F.count("*").alias("n_cases"), F.count_if(hit).alias("n_recovered"))


def leak_class(right: Column, supported: Column, in_pool: Column, hit_10: Column, in_context: Column, on_pool_page: Column, abstained: Column) -> Column:
    """Where an answer was lost: not at all, or only its support; before retrieval's pool, before the top
    ten, before the packed context (the number stands in a chunk that wasn't chosen, or in none), or
    when the answer was written."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(right) & yes(supported), LEAKS[0])
        .when(yes(right), LEAKS[1])
        .when(~yes(in_pool), LEAKS[2])
        .when(~yes(hit_10), LEAKS[3])
        .when(~yes(in_context) & yes(on_pool_page), LEAKS[4])
        .when(~yes(in_context), LEAKS[5])
        .when(yes(abstained), LEAKS[6])
        .otherwise(LEAKS[7])
    )


def leak_counts(cases: DataFrame) -> DataFrame:
    """(leak, n, recovered) of cases (leak, recovered); classes without cases have zero."""
    every = cases.sparkSession.createDataFrame([(x,) for x in LEAKS], "leak string")
    found = cases.groupBy("leak").agg(F.count("*").alias("n"), F.count_if("recovered").alias("recovered"))
    return every.join(found, "leak", "left").select("leak", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("recovered", F.lit(0)).alias("recovered"))


def arm_summary(answers: DataFrame) -> DataFrame:
    """(arm, n, accuracy, support, abstain_rate, tokens, p50, p95) of answers (arm, case_id, outcome,
    supported, tokens, latency_ms)."""
    rate = lambda ok: F.round(F.count_if(ok) / F.count("*") + 1e-9, 4)
    disc = lambda p: F.expr(f"percentile_disc({p}) within group (order by latency_ms)")
    return answers.groupBy("arm").agg(F.count("*").alias("n"), rate(F.col("outcome") == "match").alias("accuracy"), rate(F.col("supported")).alias("support"), rate(F.col("outcome") == "abstain").alias("abstain_rate"), F.sum("tokens").alias("tokens"), disc(0.5).alias("p50"), disc(0.95).alias("p95"))


def arm_pairs(answers: DataFrame, base: str) -> DataFrame:
    """(arm, gained, lost) of each arm against ``base``, over the cases that both answered."""
    right = answers.select("arm", "case_id", (F.col("outcome") == "match").alias("right"))
    other = right.where(F.col("arm") == base).select("case_id", F.col("right").alias("base"))
    return right.where(F.col("arm") != base).hint("merge").join(other, "case_id").groupBy("arm").agg(F.count_if(F.col("right") & ~F.col("base")).alias("gained"), F.count_if(~F.col("right") & F.col("base")).alias("lost"))


def citation_suite(rows: DataFrame) -> DataFrame:
    """(arm, n, emission_rate, support_rate, valid, unknown, cross_scope, p50, p95) of answers (arm,
    n_cited, n_valid, n_unknown, n_cross, supported, latency_ms)."""
    rate = lambda ok: F.round(F.count_if(ok) / F.count("*") + 1e-9, 4)
    disc = lambda p: F.expr(f"percentile_disc({p}) within group (order by latency_ms)")
    emitted = F.col("n_cited") > 0
    return rows.groupBy("arm").agg(F.count("*").alias("n"), rate(emitted).alias("emission_rate"), F.round(F.count_if(emitted & F.col("supported")) / F.greatest(F.count_if(emitted), F.lit(1)) + 1e-9, 4).alias("support_rate"), F.sum("n_valid").alias("valid"), F.sum("n_unknown").alias("unknown"), F.sum("n_cross").alias("cross_scope"), disc(0.5).alias("p50"), disc(0.95).alias("p95"))


def receipt_summary(receipts: DataFrame, *by: str) -> DataFrame:
    """(by, chunks_indexed, documents_indexed, documents_failed, documents_pending, embed_calls) of index
    receipts (status, chunk_count, embed_calls)."""
    is_ = lambda *s: F.col("status").isin(*s)
    ready = is_("ready", "skipped_duplicate")
    return receipts.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(ready, F.col("chunk_count"))), F.lit(0)).alias("chunks_indexed"),
        F.count_if(ready).alias("documents_indexed"),
        F.count_if(is_("failed")).alias("documents_failed"),
        F.count_if(is_("pending", "indexing")).alias("documents_pending"),
        F.coalesce(F.sum("embed_calls"), F.lit(0)).alias("embed_calls"),
    )


def snapshot_summary(snapshots: DataFrame, *by: str) -> DataFrame:
    """(by, ok_count, total_count, all_ok, from_cache) of snapshots (status or null, price, from_cache): one
    counts if it has a price and isn't failed."""
    status = F.coalesce("status", F.when(F.col("price").isNotNull(), "ok").otherwise("failed"))
    ok = status.isin("ok", "cached", "stale") & F.col("price").isNotNull()
    return snapshots.groupBy(*by).agg(F.count_if(ok).alias("ok_count"), F.count("*").alias("total_count"), (F.count_if(ok) == F.count("*")).alias("all_ok"), F.count_if("from_cache").alias("from_cache"))


def binding_summary(claims: DataFrame) -> DataFrame:
    """(claim_type, n, verified, page_anchored, bind_rate) of claims (claim_type, verification, page), a
    row a type and one for all, with a null type."""
    ok = F.col("verification") == "verified"
    return claims.rollup("claim_type").agg(F.count("*").alias("n"), F.count_if(ok).alias("verified"), F.count_if(ok & F.col("page").isNotNull()).alias("page_anchored"), F.round(F.count_if(ok) / F.count("*") + 1e-9, 4).alias("bind_rate"))


def alignment(companies: DataFrame) -> DataFrame:
    """Companies (run_id, company, requested, used, alignment, source, period_end date) with status; and
    for their run whether some year doesn't match, some is assumed, and the days between the earliest
    and latest period end."""
    r, u = F.col("requested"), F.col("used")
    upload = F.coalesce(F.col("source").isin("upload_filename", "upload_text"), F.lit(False)) | F.coalesce(F.col("alignment").isin("upload_filename", "upload_text", "upload_labeled"), F.lit(False))
    assumed = F.coalesce(F.col("alignment") == "assumed_from_query", F.lit(False))
    status = (
        F.when(r.isNull(), F.coalesce(F.nullif("alignment", F.lit("")), F.lit("not_requested")))
        .when(u.isNull(), "not_found")
        .when(assumed, "assumed")
        .when((u == r) & upload, "exact_upload")
        .when(u == r, "exact")
        .otherwise("fallback")
    )
    run = Window.partitionBy("run_id")
    rows = companies.withColumn("status", status)
    bad = F.col("status").isin("not_found", "fallback")
    span = F.date_diff(F.max("period_end").over(run), F.min("period_end").over(run))
    return rows.withColumns({"any_mismatch": F.bool_or(bad & r.isNotNull()).over(run), "any_assumed": F.bool_or(F.col("status") == "assumed").over(run), "span_days": F.when(F.count("period_end").over(run) >= 2, span)}).withColumn("calendars_differ", F.coalesce(F.col("span_days") >= 90, F.lit(False)))


def data_sources(runs: DataFrame, documents: DataFrame, companies: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(run_id, structured, rag, market_ok, market_ok_count, upload_formats) of runs (run_id, rag_enabled,
    chunks_indexed, sample) from what they had: documents (run_id, source_type), companies (run_id,
    structured_source, n_hits) and snapshots (run_id, price)."""
    has = lambda *kinds: F.coalesce(F.bool_or(F.col("source_type").isin(*kinds)), F.lit(False))
    d = documents.groupBy("run_id").agg(has("csv").alias("csv"), has("excel").alias("excel"), has("structured_json").alias("json"), has("pdf").alias("pdf"), has("pdf", "markdown").alias("narrative"), F.array_join(F.array_sort(F.collect_set("source_type")), ",").alias("formats"))
    c = companies.groupBy("run_id").agg(F.bool_or(F.col("structured_source") == "sec_companyfacts").alias("sec"), F.bool_or(F.col("structured_source") == "yahoo_fundamentals").alias("yahoo"), F.bool_or(F.col("n_hits") > 0).alias("hit"))
    s = snapshots.groupBy("run_id").agg(F.count("price").alias("ok"))
    yes = lambda x: F.coalesce(x, F.lit(False))
    rows = runs.join(d, "run_id", "left").join(c, "run_id", "left").join(s, "run_id", "left")
    structured = F.when(yes("csv"), "uploaded_csv").when(yes("excel"), "uploaded_excel").when(yes("json"), "uploaded_json").when(yes("sample"), "sample_db").when(yes("sec"), "sec_companyfacts").when(yes("yahoo"), "yahoo_fundamentals").when(yes("narrative"), "document_extracted").otherwise("none")
    rag = F.when(~F.col("rag_enabled"), "disabled").when(yes("hit"), "vector_hybrid").when(F.col("chunks_indexed") > 0, "indexed_no_hits").when(yes("pdf"), "pdf_no_index").when(yes("narrative"), "document_no_index").otherwise("skipped")
    return rows.select("run_id", structured.alias("structured"), rag.alias("rag"), (F.coalesce("ok", F.lit(0)) > 0).alias("market_ok"), F.coalesce("ok", F.lit(0)).alias("market_ok_count"), F.coalesce("formats", F.lit("")).alias("upload_formats"))


def company_bundles(companies: DataFrame, hits: DataFrame, payload: DataFrame, snapshots: DataFrame, confidence: DataFrame) -> DataFrame:
    """One row for each company of a run (run_id, company) with what was found for it: its best hit and
    how many (hits: chunk_id, rank, chunk_type), its payload (structured_source, n_metrics,
    supply_level), price and confidence. Without a stated supply-chain level, it is medium if a hit
    signals risk, else low."""
    keys = ["run_id", "company"]
    h = hits.groupBy(*keys).agg(F.count("*").alias("n_hits"), F.min_by("chunk_id", F.struct("rank", "chunk_id")).alias("best_chunk"), F.bool_or(F.col("chunk_type") == "risk_signal").alias("risk"))
    rows = companies
    for part in (h, payload, snapshots, confidence):
        rows = rows.hint("merge").join(part, keys, "left")
    level = F.coalesce(F.nullif("supply_level", F.lit("")), F.when(F.col("risk"), "medium").otherwise("low"))
    return rows.select(*keys, F.coalesce("n_hits", F.lit(0)).alias("n_hits"), "best_chunk", F.coalesce("structured_source", F.lit("none")).alias("structured_source"), F.coalesce("n_metrics", F.lit(0)).alias("n_metrics"), level.alias("supply_level"), "price", F.coalesce("overall", F.lit(0.0)).alias("confidence"))


def completeness(companies: DataFrame, metrics: DataFrame, sentiment: DataFrame) -> DataFrame:
    """(company, violation): companies that one of the result tables says nothing about."""
    lacks = lambda found, name: companies.select("company").hint("merge").join(found.select("company").distinct(), "company", "left_anti").select("company", F.lit(name).alias("violation"))
    return lacks(metrics, "missing_metrics").unionByName(lacks(sentiment, "missing_sentiment"))


def resolve_companies(asked: Column, uploaded: Column, explicit: Column, scope: Column) -> Column:
    """struct(companies, source, pause): companies that the user set go first, then the scope that the
    user chose; companies asked for that the uploads aren't about are a mismatch, on which to pause;
    else those asked for, else those of the uploads."""
    none = F.array().cast("array<string>")
    e, a, u = (F.array_distinct(F.coalesce(c, none)) for c in (explicit, asked, uploaded))
    word = F.lower(F.trim(F.coalesce(scope, F.lit(""))))
    mismatch = (F.size(a) > 0) & (F.size(u) > 0) & (F.size(F.array_except(a, u)) > 0)
    source = F.when(F.size(e) > 0, "explicit")
    for name, words in SCOPE_WORDS.items():
        source = source.when(word.isin(*words), name)
    source = source.when(mismatch, "mismatch").when(F.size(a) > 0, "query").when(F.size(u) > 0, "uploaded").otherwise("")
    chosen = F.when(source == "explicit", e).when(source == "both", F.array_union(a, u)).when(source == "uploaded", u).otherwise(a)
    return F.struct(chosen.alias("companies"), source.alias("source"), (source == "mismatch").alias("pause"))


def report_violations(reports: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    """(keys, code, severity) of reports without a disclaimer or provenance; blank ones have none."""
    body = F.coalesce(F.col(text), F.lit(""))
    any_of = lambda patterns: F.exists(F.array(*(body.rlike(p) for p in patterns)), lambda x: x)
    row = lambda lacks, code, severity: F.when(lacks, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    found = F.filter(F.array(row(~any_of(DISCLAIMERS), "missing_risk_disclaimer", "high"), row(~any_of(PROVENANCE), "missing_data_provenance", "medium")), lambda x: x.isNotNull())
    return reports.where(F.trim(body) != "").select(*keys, F.inline(found))


def query_features(text: Column) -> Column:
    """struct(dimensions, wants_comparison, upload_only, time_range) of a question, by rules."""
    low = F.lower(F.coalesce(text, F.lit("")))
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w))
    dimensions = F.filter(F.array(*(F.when(any_of(words), F.lit(name)) for name, words in DIMENSIONS)), lambda x: x.isNotNull())
    year = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)\b((?:FY|Q[1-4])\s*20\d{2}|20\d{2})\b", 1)
    return F.struct(dimensions.alias("dimensions"), low.rlike(r"\b(compare|comparison|versus|vs)\b|对比|比较").alias("wants_comparison"), any_of(UPLOAD_ONLY).alias("upload_only"), F.nullif(year, F.lit("")).alias("time_range"))


def case_labels(cases: DataFrame) -> DataFrame:
    """(case_id, numeric_extraction, multi_step, period, negation, multi_page, cross_document) of cases
    (case_id, question, reasoning, gold array<struct<doc, page>>)."""
    q, r = F.col("question"), F.lower(F.coalesce("reasoning", F.lit("")))
    says = lambda p: F.coalesce(q.rlike(r"(?i)\b(" + p + r")\b"), F.lit(False))
    distinct = lambda of: F.size(F.array_distinct(F.transform(F.coalesce("gold", F.array().cast(cases.schema["gold"].dataType)), of)))
    return cases.select(
        "case_id",
        (says("how much|what is the|amount|ratio|margin|capex|revenue|eps|million|billion|percent|%") | r.contains("information extraction")).alias("numeric_extraction"),
        (says("calculate|computed?|change|delta|difference|growth|cagr|exclude|if we|driven|ratio") | r.rlike("numerical reasoning|logical reasoning")).alias("multi_step"),
        says(r"fy\s*20\d{2}|fiscal|year[- ]end|as of|q[1-4]|compared to|versus|vs\.?").alias("period"),
        says("not|never|except|excluding|no longer|without|did not|isn't|is not").alias("negation"),
        (distinct(lambda g: g) > 1).alias("multi_page"),
        (distinct(lambda g: g["doc"]) > 1).alias("cross_document"),
    )


def normalized_amounts(rows: DataFrame, trusted=("caption", "statement_header", "table_header"), floor: float = 1000.0) -> DataFrame:
    """``rows`` (value, scale, currency, source, period_hint, already) with value_billion, confidence and
    norm_source: another currency than dollars is refused; a value without scale from ``floor`` on is
    taken for millions, with low confidence; so is what no trusted source scales, and a quarter."""
    v, scale = F.col("value"), F.col("scale")
    foreign = F.col("currency").isNotNull() & (F.col("currency") != "USD")
    done = F.coalesce("already", F.lit(False))
    guessed = scale.isNull() & ~done & (F.abs(v) >= floor)
    value = F.when(foreign, None).when(done, v).when((scale == "million") | guessed, v / 1e3).when(scale == "thousand", v / 1e6).otherwise(v)
    sure = F.coalesce(F.col("source").isin(*trusted), F.lit(False)) & (scale.isNotNull() | done) & ~foreign & (F.coalesce("period_hint", F.lit("")) != "quarter")
    source = F.when(foreign, F.coalesce("source", F.lit("non_usd"))).when(guessed, "inferred_million").when(done, F.coalesce("source", F.lit("pre_normalized"))).when(scale.isNull(), F.coalesce("source", F.lit("unitless"))).otherwise(F.col("source"))
    return rows.withColumns({"value_billion": F.round(value, 8), "confidence": F.when(sure, "high").otherwise("low"), "norm_source": source})
