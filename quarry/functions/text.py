"""Text columns: tokens, numbers, periods, chunk types, patterns. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the behaviour that is matched: phrase forms, keywords, markers and patterns.
PHRASES = (
    (r"(?i)operating\s+margins?", " operating_margin "),
    (r"(?i)supply\s+chains?", " supply_chain "),
    (r"(?i)r\s*&\s*d|research\s+and\s+development|\brnd\b", " r_and_d "),
    (r"(?i)r_and_d_intensity|rd\s+intensity|研发\s*强度", " r_and_d 强度 "),
)
SYNONYMS = (
    ("operating_margin", "营业利润率", "经营利润率", "营业利润"),
    ("r_and_d", "rd", "研发", "研发强度", "研发费用", "研发投入"),
    ("revenue", "sales", "收入", "营收", "营业收入", "销售额"),
    ("ebitda", "息税折旧摊销前利润"),
    ("margin", "利润率", "毛利率", "净利率"),
    ("profitability", "盈利", "盈利能力", "获利"),
    ("supply_chain", "供应链", "供应链风险", "代工"),
    ("risk", "风险", "风险点"),
    ("compare", "comparison", "对比", "比较", "对照"),
    ("intensity", "强度"),
    ("apple", "苹果"),
    ("microsoft", "微软"),
    ("nvidia", "英伟达"),
    ("tsmc", "台积电"),
    ("oracle", "甲骨文"),
)
FINANCIAL_WORDS = ("revenue", "ebitda", "margin", "profit", "r&d", "research", "supply chain", "risk", "cash flow", "operating income", "收入", "营收", "研发", "供应链", "风险", "利润")
POSITIVE = ("optimistic", "confident", "healthy", "durable", "constructive", "resilience", "strong", "growth", "accelerating", "efficiency", "gain", "record", "robust", "momentum", "remain confident", "remain optimistic", "positive")
CAUTION = ("risk", "constraints", "pressure", "remain", "challenge", "volatility", "uncertain", "headwind", "concern", "exposure", "supply chain", "concentration", "regulatory", "despite")
SUPPLY_PHRASES = ("supply chain risk", "供应链风险", "supply constraint", "supply constraints", "logistics risk", "supplier concentration", "供应商集中", "packaging capacity", "foundry")
INJECTIONS = (
    ("ignore_previous_instructions", "critical", r"(?i)ignore\s+(?:all\s+)?(?:previous|prior|above)\s+instructions?"),
    ("disregard_previous_rules", "critical", r"(?i)disregard\s+(?:all\s+)?(?:previous|prior|above)\s+(?:instructions?|rules?)"),
    ("role_override", "critical", r"(?i)you\s+are\s+now\s+(?:a|an|the)\s+"),
    ("policy_override", "critical", r"(?i)override\s+(?:safety|policy|guardrails?|system)"),
    ("prompt_exfiltration", "critical", r"(?i)reveal\s+(?:the\s+)?(?:system|hidden)\s+prompt"),
    ("system_role_marker", "warning", r"(?i)(?:^|\n)\s*system\s*:\s*"),
    ("assistant_role_marker", "warning", r"(?i)(?:^|\n)\s*assistant\s*:\s*"),
    ("xml_instruction_tag", "warning", r"(?i)<\s*/?\s*(?:system|assistant|instruction)[^>]*>"),
    ("markdown_instruction_header", "warning", r"(?i)###\s*instruction"),
    ("ignore_previous_instructions_zh", "critical", r"忽略(?:之前|此前|以上|先前)(?:的)?(?:全部|所有)?指令"),
    ("role_override_zh", "warning", r"你现在是"),
    ("policy_override_zh", "critical", r"无视(?:系统|安全|规则)"),
)
REDACTED = "[REDACTED_INJECTION]"
NUMERIC_HINTS = ("revenue", "net sales", "ebitda", "margin", "income", "eps", "debt", "cash flow", "operating", "capex", "capital expenditure", "r&d", "研发", "收入", "营收", "利润率")
METRIC_ALIASES = (
    ("revenue", ("revenue", "net sales", "sales", "营收", "收入", "净销售")),
    ("gross_margin", ("gross margin", "gross profit", "毛利率")),
    ("operating_margin", ("operating margin", "营业利润率")),
    ("operating_income", ("operating income", "income from operations", "营业利润")),
    ("net_income", ("net income", "net earnings", "净利润")),
    ("eps", ("eps", "earnings per share", "per share")),
    ("ebitda", ("ebitda",)),
    ("r_and_d", ("r&d", "r & d", "research and development", "研发")),
    ("debt", ("debt", "长期债务")),
    ("operating_cash_flow", ("operating cash", "cash from operations", "cash provided by operating", "经营活动")),
    ("capex", ("capex", "capital expenditure", "property, plant", "资本开", "资本支出")),
    ("cash", ("cash and cash equivalents", "cash equivalents", "现金及现金")),
)
METRIC_WORDS = ("revenue", "ebitda", "margin", "operating_margin", "r_and_d", "研发", "收入", "利润率", "net_income", "gross_margin", "eps", "debt", "capex")
RISK_WORDS = ("risk", "supply", "supply_chain", "风险", "供应链")
RERANK_METRIC_WORDS = ("revenue", "ebitda", "margin", "operating_margin", "r_and_d", "研发", "收入", "gpu", "利润率")
RERANK_RISK_WORDS = ("risk", "supply", "supply_chain", "风险", "供应链", "capex")


def any_of(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def count_of(text: Column, words) -> Column:
    """How many of the words occur in the text."""
    return reduce(lambda a, b: a + b, (text.contains(w).cast("long") for w in words))


def latin_tokens(text: Column, phrases: bool = True) -> Column:
    """Lower-case ASCII words of two characters or more, and digits, with repeats."""
    if phrases:
        for pattern, form in PHRASES:
            text = F.regexp_replace(text, pattern, form)
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)), lambda t: (F.length(t) > 1) | t.rlike("^[0-9]$"))


def cjk_tokens(text: Column) -> Column:
    """Runs of CJK characters, with their bigrams and trigrams."""
    runs = F.regexp_extract_all(text, F.lit("[\\u4e00-\\u9fff]+"), F.lit(0))
    grams = lambda n: F.flatten(F.transform(runs, lambda r: F.when(F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.length(r) - (n - 1)), lambda i: F.substring(r, i, n))).otherwise(F.array().cast("array<string>"))))
    return F.concat(runs, grams(2), grams(3))


def tokens(text: Column) -> Column:
    """The distinct tokens of a text."""
    text = F.coalesce(text, F.lit(""))
    return F.array_distinct(F.concat(latin_tokens(text), cjk_tokens(text)))


GROUP_OF = {m: g for g, group in enumerate(SYNONYMS) for m in group}
# what a token that is in no group may be of a group's members: a part of two characters or more
PARTS = tuple(sorted({m[i:j] for m in group for i in range(len(m)) for j in range(i + 2, len(m) + 1)} - GROUP_OF.keys()) for group in SYNONYMS)


def _bound(value: Column, use) -> Column:
    """``use(value)``, with the value evaluated once."""
    return F.transform(F.array(value), use)[0]


def synonym_groups(found: Column) -> Column:
    """The numbers of the groups that a set of tokens touches. A token in a group touches that group
    alone; another one all groups with a member that holds it (from two characters) or lies in it."""
    either = "|".join
    lies_in = sorted(set().union(*PARTS))
    likely = F.filter(found, lambda t: t.isin(*lies_in) | t.rlike(either(GROUP_OF)))

    def touches(g: int):
        whole, part = f"^(?:{either([*SYNONYMS[g], *PARTS[g]])})$", f"^(?!(?:{either(GROUP_OF)})$).*(?:{either(SYNONYMS[g])})"
        return lambda t: t.rlike(f"{whole}|{part}")

    return _bound(likely, lambda near: F.filter(F.array(*(F.when(F.exists(near, touches(g)), F.lit(g)) for g in range(len(SYNONYMS)))), lambda g: g.isNotNull()))


def _members() -> Column:
    return F.array(*(F.array(*map(F.lit, group)) for group in SYNONYMS))


def expand_synonyms(found: Column) -> Column:
    """Tokens with all members of the groups that they touch."""
    return F.array_distinct(F.concat(found, F.flatten(F.transform(synonym_groups(found), lambda g: _members()[g]))))


def closed_tokens(text: Column) -> Column:
    return _bound(tokens(text), expand_synonyms)


def closed_terms(text: Column) -> Column:
    """``closed_tokens`` in short: tokens that are in no group, and one term ``#g`` for each group."""
    return _bound(
        tokens(text), lambda found: F.concat(F.array_except(found, F.array(*map(F.lit, GROUP_OF))), F.transform(synonym_groups(found), lambda g: F.concat(F.lit("#"), g.cast("string"))))
    )


def term_weight(term: Column) -> Column:
    """How many tokens a term of ``closed_terms`` stands for."""
    sizes = F.array(*(F.lit(len(group)) for group in SYNONYMS))
    return F.when(term.startswith("#"), F.get(sizes, F.try_to_number(F.substring(term, 2, 2), F.lit("99")).cast("int"))).otherwise(1)


def holds(closed: Column, words) -> Column:
    """Whether closed tokens have one of the words."""
    return F.arrays_overlap(closed, F.array(*map(F.lit, words)))


def overlap(query_tokens: Column, text_tokens: Column) -> Column:
    """Share of the query's tokens that the text has."""
    return F.when(F.size(query_tokens) > 0, F.size(F.array_intersect(query_tokens, text_tokens)) / F.size(query_tokens)).otherwise(0.0)


def chunk_type(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(any_of(low, ("supply chain", "供应链")) & any_of(low, ("risk", "风险", "constraint", "concentration")), "risk_signal")
        .when(count_of(low, FINANCIAL_WORDS) >= 2, "financial_metric")
        .when(any_of(low, ("risk", "supply chain", "风险", "供应链")), "risk_signal")
        .when(any_of(low, ("revenue", "ebitda", "operating income", "r&d", "收入", "营收", "研发")), "financial_metric")
        .otherwise("narrative")
    )


def asks_for(query: Column, metric: Column) -> Column:
    """Whether a query's text names a metric, by its aliases or else by its own name."""
    low = F.lower(F.coalesce(query, F.lit("")))
    known = F.lit(None).cast("boolean")
    for name, aliases in METRIC_ALIASES:
        known = F.when(metric == name, any_of(low, aliases)).otherwise(known)
    return F.coalesce(known, low.contains(F.replace(metric, F.lit("_"), F.lit(" "))))


def tone(text: Column) -> Column:
    """struct(label, positive_hits, caution_hits)"""
    low = F.lower(text)
    p, c = count_of(low, POSITIVE), count_of(low, CAUTION)
    return F.struct(F.when((p == 0) & (c == 0), "neutral").when(p >= c, "bullish").otherwise("cautious").alias("label"), p.alias("positive_hits"), c.alias("caution_hits"))


def numbers(text: Column) -> Column:
    """Numbers of a text as doubles, thousands separators removed."""
    found = F.regexp_extract_all(text, F.lit(r"[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"), F.lit(0))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))


def number_matches(found: Column, gold: Column, tolerance: float = 0.01) -> Column:
    """Whether some number equals gold within a relative tolerance, in some unit."""
    scales = F.array(*(F.lit(s) for s in (1.0, 1e3, 1e6, 1e9, 1e-3, 1e-6, 1e-9)))
    return F.exists(found, lambda n: F.exists(scales, lambda s: F.abs(n * s - gold) <= tolerance * F.abs(gold)))


def redacted(text: Column) -> Column:
    for _, _, pattern in INJECTIONS:
        text = F.regexp_replace(text, pattern, REDACTED.replace("[", "\\[").replace("]", "\\]"))
    return text


def squeezed(text: Column) -> Column:
    """Lower case, white space squeezed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def period_identity(text: Column) -> Column:
    """struct(kind, year, quarter, date) of labels like FY2025, Q1 2025, 2025-09-30."""
    date = F.regexp_extract(text, r"(20\d{2}-\d{2}-\d{2})", 1)
    quarter = F.regexp_extract(text, r"(?i)q([1-4])\s*(?:fy)?\s*(20\d{2})", 1)
    year = F.regexp_extract(text, r"(20\d{2})", 1)
    kind = F.when(date != "", "date").when(quarter != "", "quarter").when(year != "", "year").otherwise("unknown")
    return F.struct(
        kind.alias("kind"),
        F.when(year != "", year.cast("int")).alias("year"),
        F.when(quarter != "", quarter.cast("int")).when(date != "", F.ceil(F.substring(date, 6, 2).cast("int") / 3).cast("int")).alias("quarter"),
        F.when(date != "", date).alias("date"),
    )


def statement_scale(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike(r"in billions|billion"), "billion").when(low.rlike(r"in millions|million"), "million").when(low.rlike(r"in thousands|thousand"), "thousand").otherwise("unit")


def statement_currency(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike(r"\$|usd|dollar"), "USD").when(low.rlike(r"€|eur\b|euro"), "EUR").when(low.rlike(r"£|gbp"), "GBP").when(low.rlike(r"¥|jpy|rmb|cny"), "OTHER").otherwise("unknown")
