"""Who may see what, and what may be shown: scopes, company tags, labels, redaction, leak checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

# Fixed values of the behaviour that is matched.
SECRET_NAMES = r"(?i)(api[_-]?key|authorization|bearer|token|password|secret|access[_-]?key|request[_-]?id|endpoint|base_url)"
TEXT_NAMES = ("text", "excerpt", "snippet", "body", "content", "question", "answer", "html")
MASKS = (
    (r"(?i)([?&](?:api[_-]?key|apikey|token|access_token|secret)=)[^&\s]+", "$1[REDACTED]"),
    (r"(?i)\b(authorization:\s*bearer\s+)[^\s,;]+", "$1[REDACTED]"),
    (r"(?i)\b(api[_-]?key|token|secret|password)\s*[=:]\s*[^\s,;&]+", "$1=[REDACTED]"),
    (r"(?i)(://)[^/\s:@]+:[^/\s@]+(@)", "$1[REDACTED]$2"),
    (r"\bsk-[A-Za-z0-9_-]+", "[REDACTED]"),
)
SAFE_HIT = ("rank", "chunk_id", "document_id", "filename", "page", "citation", "score", "retrieval_method")
SPLITS = (("test", "exposed_test", "post_hoc_paired_diagnostic", "exploratory_baseline", False), ("dev", "confirmation", "confirmation", "confirmation", True), ("all", "all", "post_hoc_paired_diagnostic", "exploratory_baseline", False))


def has_company(companies: Column, wanted: list[str]) -> Column | None:
    """Whether a list of tags, or a comma list, has one of the wanted names; None if none is wanted."""
    names = [w.strip() for w in wanted if w and w.strip()]
    if not names:
        return None
    return F.coalesce(F.arrays_overlap(companies, F.array(*map(F.lit, names))), F.lit(False))


def tags(csv: Column) -> Column:
    """The tags of a comma list; null and empty lists have none."""
    return F.filter(F.split(F.coalesce(csv, F.lit("")), ","), lambda t: t != "")


def in_scope(rows: DataFrame, tenant_id: str | None = None, session_id: str | None = None, source_ids: list[str] | None = None, document_ids: list[str] | None = None, companies: list[str] | None = None) -> DataFrame:
    """``rows`` (tenant_id, session_id, source_document_id, document_id, companies) of a scope: what is
    given must all hold; a tenant stands for a session, and sources for documents. Plain conditions,
    so they reach the scan."""
    checks = []
    if tenant_id:
        checks.append(F.col("tenant_id") == tenant_id)
    elif session_id:
        checks.append(F.col("session_id") == session_id)
    if source_ids:
        checks.append(F.col("source_document_id").isin(*source_ids))
    elif document_ids:
        checks.append(F.col("document_id").isin(*document_ids))
    match = has_company(F.col("companies"), companies or [])
    return rows.where(reduce(lambda a, b: a & b, [*checks, *([match] if match is not None else [])], F.lit(True)))


def relaxed(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits (query_id, company, companies, text, score, chunk_id) of each query that are
    tagged with its company; where a query has none, those that mention it or have no tags, marked."""
    tagged = F.coalesce(F.array_contains("companies", F.col("company")), F.lit(False))
    loose = F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lower("company")) | (F.coalesce(F.size("companies"), F.lit(0)) < 1)
    any_tagged = F.bool_or("tagged").over(Window.partitionBy("query_id"))
    rows = hits.withColumn("tagged", tagged).withColumn("loose", loose).where("tagged or loose").withColumn("relaxed", ~any_tagged).where("tagged or relaxed")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k).drop("tagged", "loose")


def plausible_label(name: Column, known: list[str]) -> Column:
    """Whether a company label is one: of 2 to 80 characters, not garbled, and known, a Latin name, or a
    short name of CJK and Latin characters."""
    raw = F.trim(F.coalesce(name, F.lit("")))
    sound = F.length(raw).between(2, 80) & ~raw.rlike("[�?]")
    return sound & (F.lower(raw).isin(*(k.lower() for k in known)) | raw.rlike(r"^[A-Za-z][A-Za-z0-9 .,&'-]{1,60}$") | raw.rlike(r"^[一-鿿A-Za-z0-9]{2,20}$"))


def for_brief(claims: DataFrame) -> DataFrame:
    """Numeric and growth claims; risks and theses, which say little in a brief, go."""
    return claims.where(F.col("claim_type").isin("numeric", "growth"))


def masked(text: Column, limit: int = 300) -> Column:
    """A message without secrets, on one line, cut to ``limit`` characters with dots at its end."""
    out = F.coalesce(text, F.lit(""))
    for pattern, form in MASKS:
        out = F.regexp_replace(out, pattern, form)
    out = F.trim(F.replace(out, F.lit("\n"), F.lit(" ")))
    return F.when(F.length(out) > limit, F.concat(F.substring(out, 1, limit - 3), F.lit("..."))).otherwise(out)


def safe_hits(hits: DataFrame, *keys: str) -> DataFrame:
    """Of the columns of hits only the keys and those that may be exported, missing ones as null."""
    return hits.select(*keys, *(F.col(c) if c in hits.columns else F.lit(None).cast("string").alias(c) for c in SAFE_HIT))


def leaking_columns(schema: StructType) -> list[str]:
    """Paths of columns, at any depth, whose names are those of texts or secrets. Looks at the schema."""
    import re

    def walk(kind: DataType, path: str) -> list[str]:
        if isinstance(kind, StructType):
            return [p for f in kind for p in ([f"{path}{f.name}"] if f.name.lower() in TEXT_NAMES or re.search(SECRET_NAMES, f.name) else walk(f.dataType, f"{path}{f.name}."))]
        if isinstance(kind, ArrayType):
            return walk(kind.elementType, path)
        return walk(kind.valueType, path) if isinstance(kind, MapType) else []

    return walk(schema, "")


def leaks(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, column, n) of rows whose text columns hold something like an API key or a credential."""
    if bad := leaking_columns(rows.schema):
        raise ValueError(f"columns that may not be exported: {bad}")
    texts = [f.name for f in rows.schema if f.dataType.simpleString() == "string" and f.name not in keys]
    found = F.filter(F.array(*(F.when(F.col(c).rlike(r"\bsk-[A-Za-z0-9_-]+|(?i)authorization:\s*bearer"), F.lit(c)) for c in texts)), lambda c: c.isNotNull())
    return rows.select(*keys, F.explode(found).alias("column")).groupBy(*keys, "column").agg(F.count("*").alias("n"))


def curated_metrics(asked: DataFrame, curated: DataFrame) -> DataFrame:
    """(query_id, company, found, metric, value, unit) of questions (query_id, company, metrics array or
    null for all) against curated (company, metric, value, unit); names match in any case. What isn't
    found keeps a row."""
    key = F.lower(F.trim("company")).alias("key")
    have = curated.where("value is not null").select(key, F.col("company").alias("name"), "metric", "value", F.coalesce("unit", F.lit("USD billions")).alias("unit"))
    rows = asked.select("query_id", key, F.trim("company").alias("company"), "metrics").hint("merge").join(have, "key", "left")
    wanted = F.col("metrics").isNull() | F.array_contains("metrics", F.col("metric"))
    kept = rows.withColumn("found", F.coalesce(wanted & F.col("metric").isNotNull(), F.lit(False)))
    kept = kept.withColumn("any", F.bool_or("found").over(Window.partitionBy("query_id"))).withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("metric")))
    shown = kept.where("found or (not any and nth = 1)")
    show = lambda c: F.when(F.col("found"), F.col(c))
    return shown.select("query_id", F.coalesce("name", "company").alias("company"), "found", show("metric").alias("metric"), show("value").alias("value"), show("unit").alias("unit"))


def split_roles(runs: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """``runs`` (split, index_scope) with canonical_split, split_status, experiment_role and held_out."""
    name = F.lower(F.trim(F.coalesce("split", F.lit(""))))
    canonical = reduce(lambda acc, kv: F.when(name == kv[0], kv[1]).otherwise(acc), aliases.items(), name)
    company = F.col("index_scope") == "company"
    pick = lambda of, other: reduce(lambda acc, s: F.when(F.col("canonical_split") == s[0], of(s)).otherwise(acc), SPLITS, other)
    return runs.withColumn("canonical_split", canonical).withColumns(
        {
            "split_status": pick(lambda s: F.lit(s[1]), F.coalesce(F.nullif("canonical_split", F.lit("")), F.lit("unknown"))),
            "experiment_role": pick(lambda s: F.when(company, s[2]).otherwise(s[3]), F.lit("unknown")),
            "held_out": pick(lambda s: F.lit(s[4]), F.lit(False)),
        }
    )


def stamped(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """Parsed documents (path, document_id, filename, companies, ...) with the identity that the registry
    (filename, document_id, company) pins, whatever was detected; unregistered ones keep theirs."""
    pinned = registry.select("filename", F.col("document_id").alias("_id"), F.col("company").alias("_company"))
    rows = docs.hint("merge").join(pinned, "filename", "left")
    return rows.withColumns({"document_id": F.coalesce("_id", "document_id"), "companies": F.when(F.col("_company").isNotNull(), F.array("_company")).otherwise(F.col("companies")), "pinned": F.col("_id").isNotNull()}).drop("_id", "_company")


def page_units(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page, text, section, heading) as retrieval units: ids, parent, and section
    metadata only where it is stated, else NOT_AVAILABLE."""
    stated = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("NOT_AVAILABLE"))
    return pages.select(F.format_string("%s:p%d", F.col("doc_id").cast("string"), "page").alias("chunk_id"), F.col("doc_id").cast("string").alias("parent_id"), "page", stated("section").alias("section"), stated("heading").alias("heading"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("char_count"))
