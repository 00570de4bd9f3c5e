"""URL filtering: rules, then host segmentation and naive Bayes.

A rule is a host and a path; it fits that host and its subdomains where the url's path starts with
the rule's, and of those that fit the longest decides. Other urls are judged by a multinomial naive
Bayes model over the words of the host and the path. Concatenated names in hosts are split into
words by a unigram Viterbi search: the words' counts come from the text of all pages, and a string
that isn't a word is worth the less the longer it is. The model learns from the urls that rules
decide, and from a few seed words. Its features are hashed into ``FEATURES`` places, so its size is
fixed whatever the corpus; the word counts are joined, not broadcast.

Nulls: a null url, and one without ``://``, has an empty host and path, no rule, and the verdict
that the model's prior gives. Names and words may have any length: a name's substrings are looked up
in those lengths that words of the pages have. Ties of the model allow. Repeated rows are judged alike. Without pages there are no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import only, table, written

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SEEDS = {
    "block": "spam cheap pills casino viagra porn xxx sex bet loan farm free win prize click adult poker replica",
    "allow": "blog news wiki docs library school university science history guide",
}
SEED_WEIGHT = 200.0
FEATURES = 1 << 16


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def page_words(html: Column) -> Column:
    """The lower-case words of a page's visible text."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_extract_all(F.lower(bare), F.lit(r"\p{L}+"), F.lit(0))


def viterbi(name: str, known: dict[tuple[int, int], int], total: float) -> list[str]:
    """The likeliest split of ``name``; ``known`` has the counts of its words by (start, end). A
    string that isn't a word is taken letter by letter or whole; what it is worth falls with every
    letter, and one string is worth more than two that make it up."""
    best, back = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
    words_at: dict[int, list[tuple[int, float]]] = {}
    for (i, j), n in known.items():
        if n:
            words_at.setdefault(j, []).append((i, math.log(n / total)))
    unknown, letter = math.log(10 / total), math.log(10)
    # the best start of an unknown string is that of the largest best[i] + i * letter so far
    start, most = 0, 0.0
    for j in range(1, len(name) + 1):
        best[j], back[j] = most + unknown - j * letter, start
        for i, value in sorted(words_at.get(j, ())):
            if best[i] + value > best[j]:
                best[j], back[j] = best[i] + value, i
        if best[j] + j * letter > most:
            start, most = j, best[j] + j * letter
    words, j = [], len(name)
    while j:
        words.append(name[back[j] : j])
        j = back[j]
    return words[::-1]


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words): ``names`` are distinct; their substrings, of the lengths that words have, are
    looked up in ``counts`` (word, n) by a join. Lengths are few: k different ones take words of
    k * k / 2 letters together."""
    total = float(counts.agg(F.sum("n")).first()[0] or 0) + 1e4
    lengths = sorted(r.k for r in counts.select(F.length("word").alias("k")).distinct().collect())
    cut = F.explode(F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda k: k <= F.length("name"))).alias("k")
    parts = (
        names.where("name <> ''")
        .select("name", cut)
        .select("name", "k", F.explode(F.expr("sequence(0, length(name) - k)")).alias("i"))
        .select("name", "i", (F.col("i") + F.col("k")).alias("j"), F.substring("name", F.col("i") + 1, F.col("k")).alias("word"))
    )
    found = (
        written(parts, "substrings")
        .hint("merge")
        .join(counts, "word")
        .groupBy("name")
        .agg(F.collect_list(F.struct("i", "j", "n")).alias("known"))  # of one name: its length times the lengths of words
    )
    every = names.hint("merge").join(written(found, "known"), "name", "left")

    def run(batches):
        for batch in batches:
            words = [viterbi(name, {(k["i"], k["j"]): k["n"] for k in known or ()}, total) for name, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["name", "words"])

    return every.select("name", "known").mapInArrow(run, "name string, words array<string>")


def _feature(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(FEATURES)).cast("int")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, words, score) of ``pages`` (page_id, url, html); score is
    the model's log odds of block."""
    spark = pages.sparkSession
    bare = only(pages, page_id="long", url="string", html="string")
    counts = written(bare.select(F.explode(page_words(F.col("html"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "words")
    urls = bare.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = written(urls.withColumn("decided", rule_of(F.col("host"), F.col("path"), rules)), "urls")
    hosts = written(urls.select("host").distinct(), "hosts")
    named = written(hosts.select("host", F.posexplode(F.filter(F.split("host", r"[.\-_:@]+"), lambda x: x != "")).alias("at", "name")), "named")
    words = written(segmented(named.select("name").distinct(), counts), "segmented")
    # a host's words in order; a host is short, or else one name
    split = named.hint("merge").join(words, "name").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("parts"))
    split = written(split.select("host", F.flatten(F.transform("parts", lambda p: p["words"])).alias("host_words")), "host-words")
    path_words = F.transform(F.regexp_extract_all(F.lower("path"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.when(w.rlike("^[0-9]+$"), "0").otherwise(w))
    rows = written(
        urls.hint("merge").join(split, "host", "left").withColumn("words", F.concat(F.coalesce("host_words", F.array().cast("array<string>")), F.transform(path_words, lambda w: F.concat(F.lit("/"), w)))).drop("host_words"),
        "tokens",
    )
    learned = (
        rows.where("decided is not null")
        .select(F.explode("words").alias("word"), (F.col("decided.verdict") == "block").alias("block"))
        .groupBy(_feature(F.col("word")).alias("feature"))
        .agg(F.count_if("block").alias("b"), F.count_if(~F.col("block")).alias("a"))
        .collect()
    )  # at most FEATURES rows
    prior = rows.where("decided is not null").agg(F.count_if(F.col("decided.verdict") == "block").alias("b"), F.count("*").alias("n")).first()
    seeds = [(w, v) for v, line in SEEDS.items() for w in line.split()]
    place = {r.word: r.f for r in spark.createDataFrame([(w,) for w, _ in seeds], "word string").select("word", _feature(F.col("word")).alias("f")).collect()}
    b, a = np.ones(FEATURES), np.ones(FEATURES)
    for r in learned:
        b[r.feature] += r.b
        a[r.feature] += r.a
    for w, v in seeds:
        (b if v == "block" else a)[place[w]] += SEED_WEIGHT
    odds = np.log(b / b.sum()) - np.log(a / a.sum())
    start = math.log((prior.b + 1) / (prior.n - prior.b + 1))

    def weigh(batches):
        for batch in batches:
            features = batch.column(batch.schema.get_field_index("features"))
            sizes = np.array([len(f) for f in features.to_pylist()])
            flat = np.asarray(features.flatten(), dtype=np.int64)
            sums = np.concatenate([[0.0], np.cumsum(odds[flat])])
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(start + sums[ends] - sums[ends - sizes])], names=[*batch.schema.names[:-1], "score"])

    kinds = "page_id long, host string, path string, rule string, decided string, words array<string>"
    scored = rows.select("page_id", "host", "path", F.col("decided.rule").alias("rule"), F.col("decided.verdict").alias("decided"), "words", F.transform("words", _feature).alias("features"))
    verdict = F.coalesce("decided", F.when(F.col("score") > 1e-9, "block").otherwise("allow"))
    return scored.mapInArrow(weigh, f"{kinds}, score double").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "words", "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
