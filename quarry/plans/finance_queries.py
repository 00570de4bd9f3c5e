"""Queries of fundamentals, scores, runs, joins and filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import finance as N
from quarry.operators import runs as U
from quarry.operators.ranking import numbered
from quarry.plans.registry import query
from quarry.plans.standins import CALLS, FACTS, calls, facts
from quarry.session import table

WIDE = f"""WITH {FACTS}, w AS (SELECT company, fy, max(CASE WHEN metric = 'revenue' THEN value END) AS revenue, max(CASE WHEN metric = 'ebitda' THEN value END) AS ebitda,
  max(CASE WHEN metric = 'r_and_d' THEN value END) AS r_and_d, max(CASE WHEN metric = 'operating_income' THEN value END) AS operating_income FROM facts GROUP BY 1, 2)"""
RATIOS = WIDE + """, r AS (SELECT *, CASE WHEN revenue > 0 THEN round(ebitda / revenue, 4) END AS ebitda_margin, CASE WHEN revenue > 0 THEN round(r_and_d / revenue, 4) END AS r_and_d_intensity,
  CASE WHEN revenue > 0 THEN round(operating_income / revenue, 4) END AS operating_margin, CASE WHEN revenue > 0 THEN round(ebitda * 0.55 / revenue, 4) END AS estimated_net_margin,
  CASE WHEN revenue > 0 THEN round(ebitda * 0.40 / revenue, 4) END AS estimated_fcf_margin,
  CASE WHEN revenue > 0 THEN CASE WHEN (revenue IS NOT NULL)::INT + (ebitda IS NOT NULL)::INT + (r_and_d IS NOT NULL)::INT + (operating_income IS NOT NULL)::INT >= 3 THEN 0.95 ELSE 0.72 END::DOUBLE END AS confidence FROM w)"""
LATEST = f"""WITH {FACTS}, latest AS (SELECT company, metric, fy, value FROM (SELECT *, row_number() OVER (PARTITION BY company, metric ORDER BY fy DESC, value DESC) AS nth FROM facts) WHERE nth = 1)"""


def _wide(spark, sf_dir):
    return N.wide(facts(spark, sf_dir))


def _ratios(spark, sf_dir):
    return N.ratios(_wide(spark, sf_dir))


@query(WIDE + " SELECT * FROM w")
def src03_pivot_wide(spark, sf_dir):
    return _wide(spark, sf_dir)


@query(RATIOS + " SELECT company, fy, ebitda_margin, r_and_d_intensity, operating_margin, confidence FROM r")
def qnt01_ratios(spark, sf_dir):
    return _ratios(spark, sf_dir).select("company", "fy", "ebitda_margin", "r_and_d_intensity", "operating_margin", "confidence")


@query(RATIOS + " SELECT company, fy, estimated_net_margin, estimated_fcf_margin FROM r")
def qnt02_derived_ratios(spark, sf_dir):
    return _ratios(spark, sf_dir).select("company", "fy", "estimated_net_margin", "estimated_fcf_margin")


@query("""WITH g AS (SELECT user_id AS company, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS price, arg_min(value, event_id) AS first_price FROM events GROUP BY 1)
SELECT company, price AS current_price, CASE WHEN high <> low THEN round((price - low) / (high - low), 4) END AS range_position, CASE WHEN first_price <> 0 THEN round(price / first_price - 1, 4) END AS period_return FROM g""")
def qnt03_market_metrics(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("company")).agg(F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("price"), F.min_by("value", "event_id").alias("first_price"))
    return g.select(
        "company",
        F.col("price").alias("current_price"),
        F.when(F.col("high") != F.col("low"), F.round((F.col("price") - F.col("low")) / (F.col("high") - F.col("low")), 4)).alias("range_position"),
        F.when(F.col("first_price") != 0, F.round(F.col("price") / F.col("first_price") - 1, 4)).alias("period_return"),
    )


@query(RATIOS + """, g AS (SELECT company, CASE WHEN coalesce(ebitda_margin, 0.15) > 0.25 THEN 0.08 ELSE 0.05 END AS g, CASE WHEN coalesce(r_and_d_intensity, 0.05) > 0.06 THEN 0.3 ELSE 0.2 END AS b FROM r WHERE fy = 1997)
SELECT company, unnest(['base', 'bull', 'bear']) AS scenario, unnest([round(g::DOUBLE, 4), round(g::DOUBLE * 1.8, 4), round(g::DOUBLE * 0.3, 4)]) AS growth, unnest([0.5::DOUBLE, b::DOUBLE, round(0.5 - b::DOUBLE, 4)]) AS probability FROM g""")
def qnt04_scenarios(spark, sf_dir):
    return N.scenarios(_ratios(spark, sf_dir).where("fy = 1997"))


RISK = RATIOS + """, i AS (SELECT company, ebitda_margin, CASE length(company) + CAST(right(company, 1) AS INT) WHEN 18 THEN 'low' WHEN 19 THEN 'medium' WHEN 20 THEN 'high' ELSE 'other' END AS risk_level,
  CAST(right(company, 1) AS INT) % 3 AS n_flags, CAST(right(company, 1) AS INT) % 4 AS positive, CAST(right(company, 1) AS INT) % 5 AS caution, CAST(right(company, 1) AS INT) / 10.0 AS range_position FROM r WHERE fy = 1997),
s AS (SELECT company, round(greatest(1.5, least(9.5, 9.0 - coalesce(ebitda_margin, 0.15) * 15)) + 1e-9, 1) AS financial_risk,
  round(least(9.5, CASE risk_level WHEN 'low' THEN 2.5 WHEN 'medium' THEN 5.5 WHEN 'high' THEN 8.0 ELSE 5.0 END + n_flags * 0.6)::DOUBLE, 1) AS operational_risk,
  round(greatest(1.0, least(9.5, 5.0 + CASE WHEN caution > positive THEN 1.8 ELSE 0 END + CASE WHEN range_position > 0.8 THEN 1.2 WHEN range_position < 0.2 THEN -1.0 ELSE 0 END))::DOUBLE, 1) AS market_risk,
  3.5::DOUBLE AS regulatory_risk, CASE risk_level WHEN 'low' THEN 2.0 WHEN 'medium' THEN 5.0 WHEN 'high' THEN 8.0 ELSE 5.0 END::DOUBLE AS supply_chain_risk FROM i)"""


@query(RISK + " SELECT *, round((financial_risk + operational_risk + market_risk + regulatory_risk + supply_chain_risk) / 5 + 1e-9, 2) AS mean_risk FROM s")
def qnt05_risk_scores(spark, sf_dir):
    last = F.right("company", F.lit(1)).cast("int")
    level = F.length("company") + last
    rows = _ratios(spark, sf_dir).where("fy = 1997").select(
        "company",
        "ebitda_margin",
        F.when(level == 18, "low").when(level == 19, "medium").when(level == 20, "high").otherwise("other").alias("risk_level"),
        (last % 3).alias("n_flags"),
        (last % 4).alias("positive"),
        (last % 5).alias("caution"),
        (last / 10.0).alias("range_position"),
    )
    return N.risk_scores(rows).drop("ebitda_margin", "risk_level", "n_flags", "positive", "caution", "range_position")


@query(f"""WITH {FACTS}, l AS (SELECT *, lag(value) OVER w AS prior, lag(fy) OVER w AS prior_fy FROM facts WHERE metric = 'revenue' WINDOW w AS (PARTITION BY company ORDER BY fy)),
r AS (SELECT *, CASE WHEN prior IS NULL THEN 'no_prior_period' WHEN prior_fy <> fy - 1 THEN 'period_gap' WHEN prior = 0 THEN 'zero_prior' ELSE 'ok' END AS reason FROM l)
SELECT company, fy, reason, CASE WHEN reason = 'ok' THEN round(value / prior - 1, 4) END AS growth FROM r""")
def qnt06_growth(spark, sf_dir):
    return N.growth(facts(spark, sf_dir))


@query(WIDE + """ SELECT company, fy, coalesce(revenue <> 0, false) AND (coalesce(ebitda <> 0, false) OR coalesce(operating_income <> 0, false) OR coalesce(r_and_d <> 0, false)) AS computable,
  round(round(((coalesce(revenue, 0) <> 0)::INT + (coalesce(ebitda, 0) <> 0)::INT + (coalesce(operating_income, 0) <> 0)::INT) / 3, 3) * 0.5 + 0.25 + round(least(1.0, (fy % 5) / 3), 3) * 0.25 + 1e-9, 3) AS confidence FROM w""")
def qnt07_retrieval_confidence(spark, sf_dir):
    w = _wide(spark, sf_dir)
    present = sum(((F.coalesce(c, F.lit(0.0)) != 0).cast("int") for c in ("revenue", "ebitda", "operating_income")), F.lit(0))
    conf = F.round(F.round(present / 3, 3) * 0.5 + 0.25 + F.round(F.least(F.lit(1.0), (F.col("fy") % 5) / 3), 3) * 0.25 + 1e-9, 3)
    return w.select("company", "fy", N.computable(F.col("revenue"), F.col("ebitda"), F.col("operating_income"), F.col("r_and_d")).alias("computable"), conf.alias("confidence"))


@query(WIDE + """, a AS (SELECT company, fy, operating_income + 0.1 * ebitda AS approx FROM w) SELECT company, fy, round(approx / 1e3 + 1e-9, 4) AS ebitda_approx, 'SEC:' || company || ':' || fy AS record_id FROM a WHERE approx IS NOT NULL""")
def qnt09_ebitda_approximation(spark, sf_dir):
    rows = _wide(spark, sf_dir).withColumn("approx", F.col("operating_income") + 0.1 * F.col("ebitda")).where("approx is not null")
    return rows.select("company", "fy", F.round(F.col("approx") / 1e3 + 1e-9, 4).alias("ebitda_approx"), F.concat_ws(":", F.lit("SEC"), "company", F.col("fy").cast("string")).alias("record_id"))


FX = """v AS (SELECT c_custkey, c_acctbal * 1e8 AS value, CASE c_nationkey % 7 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'JPY' WHEN 4 THEN 'CNY' WHEN 5 THEN 'XXX' END AS currency FROM customer),
x AS (SELECT *, CASE currency WHEN 'USD' THEN 1.0 WHEN 'EUR' THEN 1.08 WHEN 'GBP' THEN 1.27 WHEN 'JPY' THEN 0.0067 WHEN 'CNY' THEN 0.14 END::DOUBLE AS rate FROM v),
y AS (SELECT *, round(value * rate / 1e9, 8) AS b FROM x),
z AS (SELECT *, CASE WHEN rate IS NULL THEN 'unknown_currency' WHEN value IS NULL OR value = 0 THEN 'zero_revenue' WHEN NOT coalesce(b > 0 AND b <= 800, false) THEN 'implausible' ELSE 'ok' END AS reason FROM y)"""


def _fx(spark, sf_dir):
    k = F.col("c_nationkey") % 7
    cur = F.when(k == 0, "USD").when(k == 1, "EUR").when(k == 2, "GBP").when(k == 3, "JPY").when(k == 4, "CNY").when(k == 5, "XXX")
    return N.to_billion_usd(table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") * 1e8).alias("value"), cur.alias("currency")))


@query(f"WITH {FX} SELECT c_custkey, currency, reason, CASE WHEN reason = 'ok' THEN round(b, 4) END AS value_billion FROM z")
def jon19_fx_conversion(spark, sf_dir):
    return _fx(spark, sf_dir).select("c_custkey", "currency", "reason", F.round("value_billion", 4).alias("value_billion"))


@query(f"WITH {FX} SELECT reason, count(*) AS n, count(CASE WHEN reason = 'ok' THEN 1 END) > 0 AS accepted FROM z GROUP BY 1")
def qnt10_scaling_reasons(spark, sf_dir):
    return _fx(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"), (F.count_if(F.col("reason") == "ok") > 0).alias("accepted"))


@query(f"WITH {FX} SELECT c_custkey, coalesce(b > 0 AND b <= 800, false) AS plausible FROM z")
def flt07_plausible_revenue(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    fx = _fx(spark, sf_dir).select("c_custkey", F.col("reason"))
    return rows.select("c_custkey").join(fx, "c_custkey").select("c_custkey", (F.col("reason") == "ok").alias("plausible"))


@query(LATEST + " SELECT * FROM latest")
def win08_latest_fact(spark, sf_dir):
    return N.latest(facts(spark, sf_dir))


@query(f"""WITH {FACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY company, metric ORDER BY CASE WHEN fy = 1996 THEN 1 ELSE 0 END DESC, fy DESC, value DESC) AS nth FROM facts) SELECT company, metric, fy, value FROM r WHERE nth = 1""")
def win08_requested_year(spark, sf_dir):
    return N.latest(facts(spark, sf_dir), 1996)


@query(LATEST + """, a AS (SELECT company, fy, value AS anchor_value FROM latest WHERE metric = 'revenue'), c AS (SELECT * FROM facts WHERE metric = 'ebitda'), l AS (SELECT company, value AS last FROM latest WHERE metric = 'ebitda')
SELECT a.company, a.fy, anchor_value, coalesce(c.value, l.last) AS companion_value, c.value IS NOT NULL AS aligned FROM a LEFT JOIN c ON c.company = a.company AND c.fy = a.fy LEFT JOIN l ON l.company = a.company""")
def jon20_companion_fact(spark, sf_dir):
    return N.same_period(facts(spark, sf_dir), "revenue", "ebitda")


SIDES = f"""WITH {FACTS}, d AS (SELECT company, metric, value FROM facts WHERE fy = 1995 AND (metric <> 'ebitda' OR company < 'Supplier#000000050')), l AS (SELECT company, metric, value FROM facts WHERE fy = 1996)"""


def _sides(spark, sf_dir):
    f = facts(spark, sf_dir)
    return f.where("fy = 1995 and (metric <> 'ebitda' or company < 'Supplier#000000050')").select("company", "metric", "value"), f.where("fy = 1996").select("company", "metric", "value")


@query(SIDES + " SELECT company, metric, coalesce(d.value, l.value) AS value, d.value IS NULL AND l.value IS NOT NULL AS filled FROM d FULL JOIN l USING (company, metric)")
def jon06_gap_fill(spark, sf_dir):
    return N.fill_gaps(*_sides(spark, sf_dir))


@query(SIDES + """, u AS (SELECT *, 'document' AS source, 0 AS place FROM d UNION ALL SELECT *, 'live', 1 FROM l), n AS (SELECT *, count(*) OVER (PARTITION BY company, source) AS n FROM u)
SELECT company, metric, value, source FROM (SELECT *, min(place) OVER (PARTITION BY company) AS best FROM n WHERE n >= 3) WHERE place = best""")
def jon07_source_precedence(spark, sf_dir):
    d, live = _sides(spark, sf_dir)
    return N.by_precedence([("document", d), ("live", live)], 3)


@query("""SELECT o_orderkey, CASE WHEN regexp_matches(k, '^(revenue|ebitda|r_and_d|operating_income|subsidiary_revenue)(_20\\d{2})?$') THEN regexp_replace(k, '_20\\d{2}$', '') END AS canonical
FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'revenue_2025' WHEN 1 THEN 'ebitda' WHEN 2 THEN 'r_and_d_2024' WHEN 3 THEN 'revenue_1999' WHEN 4 THEN 'operating_income' ELSE 'other' END AS k FROM orders)""")
def flt11_canonical_keys(spark, sf_dir):
    m = F.col("o_orderkey") % 6
    k = F.when(m == 0, "revenue_2025").when(m == 1, "ebitda").when(m == 2, "r_and_d_2024").when(m == 3, "revenue_1999").when(m == 4, "operating_income").otherwise("other")
    return table(spark, sf_dir, "orders").select("o_orderkey", N.canonical_name(k).alias("canonical"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'FY' || year(o_orderdate) WHEN o_orderkey % 4 = 1 THEN 'Q1 ' || year(o_orderdate) WHEN o_orderkey % 4 = 2 THEN CASE WHEN year(o_orderdate) >= 2000 THEN 'FY' ELSE 'FY' END || year(o_orderdate) ELSE strftime(o_orderdate, '%Y-%m-%d') END AS label FROM orders""")
def flt12_period_label(spark, sf_dir):
    m, year = F.col("o_orderkey") % 4, F.year("o_orderdate").cast("string")
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        N.period_label(F.when(m == 0, year), F.when(m == 1, F.concat(F.lit("Q1 "), year)), F.when(m == 2, year), F.when(m == 3, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(none)).alias("label"),
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round((l_extendedprice - l_quantity) / (l_discount * 10) + l_tax ** 2, 4) AS result FROM lineitem WHERE l_discount > 0
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, NULL FROM lineitem WHERE l_discount = 0""")
def flt14_formula(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    f = N.compile_formula("(l_extendedprice - l_quantity) / (l_discount * 10) + l_tax ** 2", li.columns)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", f.alias("result"))


@query(f"WITH {CALLS} SELECT count(DISTINCT logical_call_id) AS logical_calls, count(*) AS attempts, round(count(*) / count(DISTINCT logical_call_id), 4) AS amplification, count(*) - count(error_class) AS succeeded, count(CASE WHEN error_class IN ('timeout', 'rate_limited') THEN 1 END) AS transient, round(sum(latency_ms), 2) AS latency_ms FROM calls")
def agg18_call_trace(spark, sf_dir):
    return U.call_summary(calls(spark, sf_dir))


@query(f"WITH {CALLS} SELECT error_class, provider, count(*) AS n FROM calls WHERE error_class IS NOT NULL GROUP BY GROUPING SETS ((error_class), (provider), ())")
def agg19_provider_errors(spark, sf_dir):
    calls(spark, sf_dir).createOrReplaceTempView("quarry_calls")
    return spark.sql("SELECT error_class, provider, count(*) AS n FROM quarry_calls WHERE error_class IS NOT NULL GROUP BY GROUPING SETS ((error_class), (provider), ())")


@query(f"WITH {CALLS} SELECT provider, count(*) AS total, count(CASE WHEN k > 50 THEN 1 END) AS bound, round(count(CASE WHEN k > 50 THEN 1 END) / count(*), 4) AS bind_rate FROM calls GROUP BY ROLLUP (provider)")
def agg20_binding_summary(spark, sf_dir):
    bound = F.count_if(F.col("k") > 50)
    return calls(spark, sf_dir).rollup("provider").agg(F.count("*").alias("total"), bound.alias("bound"), F.round(bound / F.count("*"), 4).alias("bind_rate"))


@query(f"""WITH {CALLS} SELECT run_id, count(*) AS n_calls, bool_or(error_class IS NOT NULL) AS degraded, array_to_string(list_sort(list_distinct(list(provider))), ',') AS providers, arg_min(provider, CASE provider WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 ELSE 2 END * 1000000000 + event_id) AS primary_mode FROM calls GROUP BY 1""")
def agg17_retrieval_telemetry(spark, sf_dir):
    p = F.col("provider")
    place = F.when(p == "purchase", 0).when(p == "view", 1).otherwise(2).cast("long") * 1000000000 + F.col("event_id")
    return calls(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("n_calls"), F.bool_or(F.col("error_class").isNotNull()).alias("degraded"), F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("providers"), F.min_by("provider", place).alias("primary_mode"))


@query(f"""WITH {CALLS}, t AS (SELECT run_id, sum(k * 100) AS prompt, sum(k * 7) AS completion, round(sum(latency_ms), 2) AS latency_ms FROM calls GROUP BY 1)
SELECT run_id, CAST(prompt AS BIGINT) AS prompt_tokens, CAST(completion AS BIGINT) AS completion_tokens, latency_ms, round(prompt * 0.27 / 1e6 + completion * 1.10 / 1e6, 6) AS cost_usd FROM t""")
def agg29_run_cost(spark, sf_dir):
    t = calls(spark, sf_dir).groupBy("run_id").agg(F.sum(F.col("k") * 100).alias("prompt_tokens"), F.sum(F.col("k") * 7).alias("completion_tokens"), F.round(F.sum("latency_ms"), 2).alias("latency_ms"))
    return t.withColumn("cost_usd", F.round(F.col("prompt_tokens") * 0.27 / 1e6 + F.col("completion_tokens") * 1.10 / 1e6, 6))


@query("""WITH r AS (SELECT user_id AS run_id, 5 - count(DISTINCT event_type) AS n_missing, count(CASE WHEN event_type = 'error' AND value > 40 THEN 1 END) % 4 AS n_blocked, count(CASE WHEN event_type = 'error' THEN 1 END) % 6 AS n_errors FROM events GROUP BY 1),
s AS (SELECT *, round((greatest(0, 100 - 15 * n_missing - 10 * n_blocked) + greatest(0, 100 - 20 * n_errors)) / 2.0, 1)::DOUBLE AS score FROM r) SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' ELSE 'D' END AS grade FROM s""")
def agg28_run_quality(spark, sf_dir):
    e = F.col("event_type") == "error"
    runs = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id")).agg((5 - F.count_distinct("event_type")).alias("n_missing"), (F.count_if(e & (F.col("value") > 40)) % 4).alias("n_blocked"), (F.count_if(e) % 6).alias("n_errors"))
    return U.quality(runs)


@query(f"WITH {FACTS} SELECT company, CASE WHEN count(DISTINCT fy) >= 2 THEN datediff('day', make_date(min(fy), 12, 31), make_date(max(fy), 12, 31)) END AS span_days FROM facts GROUP BY 1")
def agg30_period_span(spark, sf_dir):
    end = lambda y: F.make_date(y.cast("int"), F.lit(12), F.lit(31))
    return facts(spark, sf_dir).groupBy("company").agg(F.when(F.count_distinct("fy") >= 2, F.datediff(end(F.max("fy")), end(F.min("fy"))).cast("long")).alias("span_days"))


@query("""WITH i AS (SELECT DISTINCT source, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 2) AS bucket, CAST(doc_id AS VARCHAR) AS id FROM documents),
p AS (SELECT source, bucket, sha256(array_to_string(list_sort(list(id)), chr(10))) AS h, count(*) AS n FROM i GROUP BY 1, 2)
SELECT source, CAST(sum(n) AS BIGINT) AS n_ids, sha256(string_agg(h, chr(10) ORDER BY bucket)) AS fingerprint FROM p GROUP BY 1""")
def agg26_ids_fingerprint(spark, sf_dir):
    return U.ids_fingerprint(table(spark, sf_dir, "documents"), "doc_id", "source")


SPLIT = """s AS (SELECT o_custkey, CASE WHEN ('0x' || substr(sha256('v1' || chr(0) || CAST(o_custkey AS VARCHAR)), 1, 12))::BIGINT / 281474976710656 < 0.2 THEN 'dev' ELSE 'test' END AS role FROM orders)"""


def _split(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_custkey", F.when(U.hash_fraction("v1", F.col("o_custkey").cast("string")) < 0.2, "dev").otherwise("test").alias("role"))


@query(f"WITH {SPLIT} SELECT o_custkey, role, count(*) AS n_orders FROM s GROUP BY 1, 2")
def win19_hash_split(spark, sf_dir):
    return _split(spark, sf_dir).groupBy("o_custkey", "role").agg(F.count("*").alias("n_orders"))


@query(f"WITH {SPLIT} SELECT role, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_companies, (SELECT count(*) FROM (SELECT o_custkey FROM s GROUP BY 1 HAVING count(DISTINCT role) > 1)) AS n_in_both FROM s GROUP BY 1")
def agg27_split_manifest(spark, sf_dir):
    s = _split(spark, sf_dir)
    both = s.groupBy("o_custkey").agg(F.count_distinct("role").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_in_both"))
    return s.groupBy("role").agg(F.count("*").alias("n_rows"), F.count_distinct("o_custkey").alias("n_companies")).crossJoin(F.broadcast(both))  # one row


@query("SELECT s_name, row_number() OVER (ORDER BY sha256('salt|' || s_name), s_name) <= 20 AS dev FROM supplier")
def win18_ordered_split(spark, sf_dir):
    s = numbered(table(spark, sf_dir, "supplier").select("s_name"), F.sha2(F.concat(F.lit("salt|"), "s_name"), 256), "s_name")
    return s.select("s_name", (F.col("position") < 20).alias("dev"))


@query("WITH k AS (SELECT s_name, row_number() OVER (ORDER BY s_name) - 1 AS place, count(*) OVER () AS n FROM supplier) SELECT s_name, place FROM k WHERE place IN (SELECT DISTINCT i.range * (k2.n - 1) // 6 FROM range(7) i, (SELECT count(*) AS n FROM supplier) k2)")
def win15_even_sample(spark, sf_dir):
    return U.even_sample(table(spark, sf_dir, "supplier"), "s_name", 7)


@query("SELECT o_custkey, o_orderkey, nth FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth FROM orders) WHERE nth BETWEEN 3 AND 5")
def win16_slice_per_company(spark, sf_dir):
    own = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(own).cast("long").alias("nth")).where("nth between 3 and 5")


@query("SELECT s_name, (row_number() OVER (ORDER BY s_name) - 1) % 17 AS shard FROM supplier")
def win17_modulo_shards(spark, sf_dir):
    return numbered(table(spark, sf_dir, "supplier").select("s_name"), "s_name").select("s_name", F.pmod("position", F.lit(17)).alias("shard"))


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def win21_recent_listing(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25).select("o_orderkey", "o_orderstatus")


@query(LATEST + """ SELECT metric, arg_max(company, (value, company)) AS leader, arg_min(company, (value, company)) AS trailer, round(max(value) - min(value), 2) AS delta, max(value) = min(value) AS tie FROM latest GROUP BY 1""")
def win20_peer_leader(spark, sf_dir):
    v = F.struct("value", "company")
    return N.latest(facts(spark, sf_dir)).groupBy("metric").agg(F.max_by("company", v).alias("leader"), F.min_by("company", v).alias("trailer"), F.round(F.max("value") - F.min("value"), 2).alias("delta"), (F.max("value") == F.min("value")).alias("tie"))


@query("""WITH v AS (SELECT DISTINCT user_id AS run_id, CASE event_type WHEN 'error' THEN 'missing_structured_data' WHEN 'view' THEN 'missing_risk_disclaimer' WHEN 'click' THEN 'unknown_code' WHEN 'signup' THEN 'missing_data_provenance' ELSE 'missing_sentiment_analysis' END AS code FROM events WHERE user_id % 3 = 0 OR event_type <> 'purchase'),
p(code, target, priority) AS (VALUES ('missing_quantitative_results', 'quant', 100), ('missing_sentiment_analysis', 'psychologist', 90), ('missing_structured_data', 'retrieval', 80), ('low_retrieval_confidence', 'retrieval', 70), ('missing_risk_disclaimer', 'quant', 20), ('missing_data_provenance', 'quant', 10))
SELECT run_id, coalesce(arg_max(target, priority), 'quant') AS target FROM v LEFT JOIN p USING (code) GROUP BY 1""")
def qnt12_repair_target(spark, sf_dir):
    e = F.col("event_type")
    code = F.when(e == "error", "missing_structured_data").when(e == "view", "missing_risk_disclaimer").when(e == "click", "unknown_code").when(e == "signup", "missing_data_provenance").otherwise("missing_sentiment_analysis")
    v = table(spark, sf_dir, "events").where("user_id % 3 = 0 or event_type <> 'purchase'").select(F.col("user_id").alias("run_id"), code.alias("code")).distinct()
    return N.repair_targets(v)


@query(WIDE + """, c AS (SELECT fy AS run_id, company, coalesce(revenue <> 0, false) AND coalesce(ebitda <> 0, false) AS comparable FROM w)
SELECT run_id, count(*) AS n_companies, count(CASE WHEN comparable THEN 1 END) AS n_comparable, count(CASE WHEN comparable THEN 1 END) >= 1 AND count(CASE WHEN comparable THEN 1 END) < count(*) AS partial_gap FROM c GROUP BY 1""")
def agg21_coverage(spark, sf_dir):
    c = _wide(spark, sf_dir).select(F.col("fy").alias("run_id"), "company", N.computable(F.col("revenue"), F.col("ebitda")).alias("comparable"))
    return N.coverage(c)


@query(f"WITH {CALLS} SELECT event_id, CASE k WHEN 4 THEN 'not_found' ELSE CASE k % 5 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'transient_http' WHEN 2 THEN 'timeout' WHEN 3 THEN 'connection' ELSE 'error' END END AS error_class FROM calls")
def flt19_error_class(spark, sf_dir):
    c = calls(spark, sf_dir)
    m = F.col("k") % 5
    status = F.when(F.col("k") == 4, 404).when(m == 0, 429).when(m == 1, 503)
    message = F.when(m == 2, "Request timed out").when(m == 3, "Connection reset")
    return c.select("event_id", U.error_class(status, message).alias("error_class"))


LEASES = """l AS (SELECT user_id AS doc_id, event_id AS seq, 'w' || event_id % 3 AS owner, event_id // 400 % 5 AS attempt, CAST(epoch_us(ts) AS BIGINT) AS at_us, CAST(epoch_us(ts) + 3600000000 * 24 * 20 AS BIGINT) AS expires,
  CASE event_type WHEN 'signup' THEN 'claim' WHEN 'click' THEN 'claim' WHEN 'view' THEN 'renew' ELSE 'finish' END AS action FROM events)"""


@query(f"""WITH {LEASES}, r AS (SELECT *, max(attempt) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS newest, lag(expires) OVER (PARTITION BY doc_id, owner, attempt ORDER BY seq) AS lease FROM l)
SELECT doc_id, seq, owner, attempt, at_us, expires, action, coalesce(action = 'claim' OR (attempt = newest AND lease >= at_us), false) AS accepted FROM r""")
def str03_lease_audit(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    kind = F.col("event_type")
    rows = e.select(
        F.col("user_id").alias("doc_id"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("w"), (F.col("event_id") % 3).cast("string")).alias("owner"),
        (F.floor(F.col("event_id") / 400) % 5).alias("attempt"),
        t.alias("at_us"),
        (t + 3600000000 * 24 * 20).alias("expires"),
        F.when(kind.isin("signup", "click"), "claim").when(kind == "view", "renew").otherwise("finish").alias("action"),
    )
    return U.lease_audit(rows)


@query("""WITH d AS (SELECT event_id // 2 % 2000 AS job_id, event_id AS seq, CASE WHEN event_id % 11 = 0 THEN 'b' ELSE 'a' END AS identity FROM events),
r AS (SELECT *, row_number() OVER w AS nth, first_value(identity) OVER w AS f FROM d WINDOW w AS (PARTITION BY job_id ORDER BY seq))
SELECT job_id, seq, identity, CASE WHEN nth = 1 THEN 'run' WHEN identity = f THEN 'skip' ELSE 'conflict' END AS decision FROM r""")
def str06_redelivery(spark, sf_dir):
    d = table(spark, sf_dir, "events").select((F.floor(F.col("event_id") / 2) % 2000).alias("job_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 11 == 0, "b").otherwise("a").alias("identity"))
    return U.redelivery(d)


@query("""WITH l AS (SELECT user_id AS ticker, arg_max({'t': ts, 'p': value}, (ts, value)) AS s FROM events GROUP BY 1)
SELECT ticker, epoch_us(s.t) AS fetched_us, s.p AS price, CASE WHEN s.p IS NULL THEN 'failed' WHEN epoch_us((SELECT max(ts) FROM events)) - epoch_us(s.t) <= 86400000000 THEN 'cached' ELSE 'stale' END AS status FROM l""")
def str04_snapshot_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("ticker"), F.col("ts").cast("timestamp").alias("fetched_at"), F.col("value").alias("price"))
    now = e.agg(F.max("fetched_at")).first()[0]
    return U.snapshot_status(e, F.lit(now).cast("timestamp"), 86400).select("ticker", F.unix_micros("fetched_at").alias("fetched_us"), "price", "status")
