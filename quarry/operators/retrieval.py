"""Retrieval for a table of queries: postings, BM25, dense search, lexical scores, rerank, policy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import task_scores as S
from quarry.operators.impacts import candidates
from quarry.operators.ranking import TIE, top_k
from quarry.session import scratch_path, written

K1, B = 1.2, 0.75
BROADCAST_ROWS = 200_000  # of short strings or ids


def postings(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, key, tf, dl): term counts, with the document's length in terms. Tokens stay within
    their row's document until they are counted, so the only shuffle is that of distinct terms."""
    words = T.latin_tokens(F.coalesce("text", F.lit("")), phrases=False)
    rows = docs.select(key, words.alias("words")).select(key, F.size("words").cast("long").alias("dl"), F.explode("words").alias("term"))
    return rows.groupBy("term", key, "dl").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term), distinct."""
    return queries.select("query_id", F.explode(F.array_distinct(T.latin_tokens(F.coalesce("text", F.lit("")), phrases=False))).alias("term"))


def scoped(rows: DataFrame, scopes: DataFrame | None, on: str, key: str) -> DataFrame:
    """``rows`` with their ``scope``: one for all, or each of theirs in ``scopes`` (key, scope)."""
    if scopes is None:
        return rows.withColumn("scope", F.lit(0).cast("long"))
    return rows.hint("merge").join(scopes.select(F.col(key).alias(on), "scope").distinct(), on)


def found_in(terms: DataFrame, postings: DataFrame, k: int, scopes: bool, **pruning) -> DataFrame:
    """``candidates``; a query with several scopes is searched in each by itself, and a document found
    in more than one has its best score."""
    if not scopes:
        return candidates(terms, postings, k, **pruning)
    found = candidates(terms.withColumn("query_id", F.struct("query_id", "scope")), postings, k, **pruning)
    return found.groupBy(F.col("query_id.query_id").alias("query_id"), "key").agg(F.max("score").alias("score"))


def wanted_terms(terms: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (term, ...) whose term is one of ``terms``, or null. The terms are broadcast if there are
    at most BROADCAST_ROWS of them, so that nothing else leaves the tasks."""
    wanted = written(terms.select("term", F.lit(True).alias("wanted")).distinct(), "terms")
    met = rows.join(F.broadcast(wanted), "term", "left") if wanted.count() <= BROADCAST_ROWS else rows.hint("merge").join(wanted, "term", "left")
    return met.where(F.col("term").isNull() | F.col("wanted")).drop("wanted")


def documents_of(hits: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that hits name. Their keys are broadcast if there are at most BROADCAST_ROWS, so
    that the other texts stay in their tasks."""
    ids = written(hits.select(key).distinct(), "hit-keys")
    return docs.join(F.broadcast(ids), key) if ids.count() <= BROADCAST_ROWS else docs.hint("merge").join(ids, key)


Scopes = tuple[DataFrame, DataFrame]


def _distinct(rows: DataFrame, key: str) -> bool:
    return rows.groupBy(key).count().where("count > 1").isEmpty()


def _bm25_in_tasks(terms: DataFrame, docs: DataFrame, k: int, key: str, scopes: Scopes | None) -> DataFrame | None:
    """(query_id, key, score) of each task's best (``task_scores``); None where a key has several rows,
    which are then one document."""
    vocabulary = S.shared(terms.select("term").distinct(), "vocabulary")
    entries = S.word_entries(docs, key, vocabulary)
    if not _distinct(entries, key):
        return None
    spark = docs.sparkSession
    n, total = entries.agg(F.count("*"), F.sum("dl")).first()
    order = Window.orderBy("term")  # of the queries' terms, at most MOST_TERMS
    ids = spark.read.parquet(vocabulary).select("term", (F.row_number().over(order) - 1).alias("id"))
    df = ids.hint("merge").join(entries.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df")), "id")
    weighed = terms.hint("merge").join(df, "term").select("query_id", "term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("weight"), F.lit(1.0).alias("n"), F.lit(0).alias("kinds"))
    if scopes is not None:
        owned = scopes[1].select(key, F.xxhash64("scope").alias("scope")).distinct().groupBy(key).agg(F.collect_list("scope").alias("scopes"))
        entries = entries.hint("merge").join(owned, key)
    mean = float(total / n) if n and total else 1.0
    return S.best_of_tasks(weighed, entries, key, k, vocabulary, lambda tf, dl: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean)), scopes=scopes and scopes[0])


def bm25(queries: DataFrame, docs: DataFrame, k: int = 10, key: str = "doc_id", scopes: Scopes | None = None, own_statistics: bool = False, **pruning) -> DataFrame:
    """(query_id, key, score, rank): the k best documents of each query. idf is
    ln(1 + (N - df + 0.5) / (df + 0.5)); documents of no terms count for N and the mean length.

    Texts are read once: each gives its occurrences of the queries' terms and, with a null term, its
    length. Where the queries have few terms, documents are scored in the tasks that read them
    (``task_scores``); else, or with ``pruning``, terms and postings meet only where ``scopes``, two tables (query_id, scope) and (key,
    scope), give them a scope in common, before anything is ranked; N, df and the mean length are
    the corpus's, or with ``own_statistics`` the scope's. Frequent terms are pruned (``impacts``)."""
    terms = written(query_terms(queries), "query-terms")
    if not pruning and not (scopes is not None and own_statistics) and terms.count() <= S.MOST_TERMS:
        best = _bm25_in_tasks(terms, docs, k, key, scopes)
        if best is not None:
            best = best.select("query_id", key, F.round("score", 4).alias("score"))
            return top_k(best, k, tie=key).withColumnRenamed("top_rank", "rank")
    words = T.latin_tokens(F.coalesce("text", F.lit("")), phrases=False)
    rows = docs.select(key, words.alias("words")).select(key, F.size("words").cast("long").alias("dl"), F.explode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("term"))
    post = written(wanted_terms(terms, rows).groupBy("term", key, "dl").agg(F.count("*").alias("tf")), "postings")
    mine, lengths = post.where("term is not null"), post.where("term is null")
    if scopes is not None:
        terms = written(scoped(terms, scopes[0], "query_id", "query_id"), "scoped-terms")
        owned = written(scopes[1].select(key, "scope").distinct(), "scopes")
        inside = written(mine.hint("merge").join(owned, key), "scoped-postings")
    else:
        terms, inside = scoped(terms, None, "query_id", "query_id"), scoped(mine, None, key, key)
    if own_statistics and scopes is not None:
        shape = lengths.hint("merge").join(owned, key).groupBy("scope").agg(F.sum("tf").cast("double").alias("n"), (F.sum(F.col("dl") * F.col("tf")) / F.sum("tf")).alias("mean"))
        df = inside.groupBy("scope", "term").agg(F.count("*").alias("df")).hint("merge").join(written(shape, "scope-shapes"), "scope")
        inside = inside.hint("merge").join(written(df, "scope-df"), ["scope", "term"])
    else:
        n, total = lengths.agg(F.sum("tf"), F.sum(F.col("dl") * F.col("tf"))).first()
        df = written(mine.groupBy("term").agg(F.count("*").alias("df")), "df")
        inside = inside.hint("merge").join(df, "term").withColumns({"n": F.lit(float(n or 0)), "mean": F.lit(float(total / n if n else 0))})
    mean = F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0)
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    impact = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean))
    scored = found_in(terms.withColumn("weight", F.lit(1.0)), inside.select("scope", "term", F.col(key).alias("key"), impact.alias("impact")), k, scopes is not None, **pruning)
    scored = scored.select("query_id", F.col("key").alias(key), F.round("score", 4).alias("score"))
    return top_k(scored, k, tie=key).withColumnRenamed("top_rank", "rank")


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, block: int = 4096, scopes: Scopes | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank) for (query_id, embedding) against (vec_id, embedding).

    Both sides are packed in blocks of one scope, the queries' in files of the shared folder. A task
    holds one block of the vectors that it reads anyway and takes its scope's query blocks one by one;
    each pair of blocks is one matrix product, of which only the k best a query are shuffled. Vectors
    don't leave their task, unless ``scopes``, tables (query_id, scope) and (vec_id, scope), give them
    their scopes; a query meets no vector outside of its own. A null, empty or zero vector matches nothing."""

    def packed(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, block):
                part = batch.slice(i, block)
                rows = [(scope, len(v), key, v) for key, v, scope in zip(*(c.to_pylist() for c in part.columns)) if v and None not in v and any(v)]
                for kind in sorted({r[:2] for r in rows}):
                    same = [r[2:] for r in rows if r[:2] == kind]
                    m = np.array([v for _, v in same], np.float64)
                    yield kind, np.array([key for key, _ in same], np.int64), m / np.linalg.norm(m, axis=1, keepdims=True)

    def pack(batches):
        for (scope, width), q, m in packed(batches):
            columns = [pa.array([scope], pa.int64()), pa.array([width], pa.int32()), pa.array([q.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["scope", "width", "q", "q_m"])

    def dealt(rows: DataFrame, key: str, side: int) -> DataFrame:
        """(key, embedding, scope number), scopes together."""
        if scopes is None:
            return rows.select(key, "embedding", F.lit(0).cast("long").alias("scope"))
        own = scopes[side].select(key, F.xxhash64("scope").alias("scope")).distinct()
        return rows.select(key, "embedding").hint("merge").join(own, key).select(key, "embedding", "scope").sortWithinPartitions("scope")

    path = scratch_path(queries.sparkSession, "query-blocks")
    dealt(queries, "query_id", 0).mapInArrow(pack, "scope long, width int, q binary, q_m binary").write.parquet(path)

    def multiply(batches):
        store, folder = pafs.FileSystem.from_uri(path)
        files = sorted(f.path for f in store.get_file_info(pafs.FileSelector(folder)) if f.path.endswith(".parquet"))
        for (scope, width), v, m in packed(batches):
            for file in files:
                with store.open_input_file(file) as source:
                    blocks = pq.ParquetFile(source)
                    kinds = blocks.read(columns=["scope", "width"]).to_pylist() if blocks.metadata.num_rows else []
                    if {"scope": scope, "width": width} not in kinds:
                        continue
                    for one in blocks.iter_batches(batch_size=1):
                        for q_scope, q_width, q, q_m in zip(*(c.to_pylist() for c in one.columns)):
                            if (q_scope, q_width) != (scope, width):
                                continue
                            q = np.frombuffer(q, np.int64)
                            s = np.round(np.frombuffer(q_m).reshape(len(q), -1) @ m.T, 4)
                            order = np.lexsort((np.broadcast_to(v, s.shape), -s), axis=1)[:, :k]
                            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, order.shape[1])), pa.array(v[order].ravel()), pa.array(np.take_along_axis(s, order, axis=1).ravel())], names=["query_id", "vec_id", "score"])

    best = dealt(vectors, "vec_id", 1).mapInArrow(multiply, "query_id long, vec_id long, score double")
    if scopes is not None:  # a query and a vector may share several scopes
        best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return top_k(best, k, tie="vec_id").withColumnRenamed("top_rank", "rank")


def closed_queries(queries: DataFrame) -> DataFrame:
    """(query_id, query_text, n, m, r, numeric, term, weight) of queries (query_id, text): a row for each
    term of the closed tokens (``text.closed_terms``), n tokens in all; whether they ask for a metric
    or a risk, and whether the text asks for a number."""
    low = F.lower(F.coalesce("text", F.lit("")))
    q = written(queries.select("query_id", low.alias("query_text"), T.closed_tokens(F.col("text")).alias("closed"), T.closed_terms(F.col("text")).alias("terms"), T.any_of(low, T.NUMERIC_HINTS).alias("numeric")), "closed-queries")
    q = q.select("query_id", "query_text", F.size("closed").alias("n"), T.holds(F.col("closed"), T.METRIC_WORDS).alias("m"), T.holds(F.col("closed"), T.RISK_WORDS).alias("r"), "numeric", F.explode_outer("terms").alias("term"))
    return q.withColumn("weight", T.term_weight(F.col("term")))


def closed_postings(terms: DataFrame, chunks: DataFrame, *columns: str) -> DataFrame:
    """(chunk_id, chunk_type, columns, term): the closed terms of chunks (chunk_id, text) that queries have."""
    c = chunks.select("chunk_id", T.chunk_type(F.coalesce("text", F.lit(""))).alias("chunk_type"), *columns, F.explode(T.closed_terms(F.col("text"))).alias("term"))
    return wanted_terms(terms.where("term is not null"), c)


def _type_bonus() -> Column:
    return F.when((F.col("chunk_type") == "financial_metric") & F.col("m"), 0.15).when((F.col("chunk_type") == "risk_signal") & F.col("r"), 0.15).otherwise(0.0)


def lexical_scores(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score): share of the query's tokens in a chunk, both closed under synonyms,
    with a bonus where its type answers the query. Candidates come from shared tokens, never from all pairs."""
    q = written(closed_queries(queries), "query-terms")
    shared = q.hint("merge").join(closed_postings(q, chunks), "term").groupBy("query_id", "chunk_id", "n", "m", "r", "chunk_type").agg(F.sum("weight").alias("common"))
    return shared.select("query_id", "chunk_id", F.round(F.least(F.lit(1.0), F.col("common") / F.col("n") + _type_bonus()), 4).alias("score"))


def _lexical_in_tasks(terms: DataFrame, chunks: DataFrame, k: int) -> DataFrame | None:
    """As ``_bm25_in_tasks``, for closed terms; kind 1 is a metric's chunk, 2 a risk's."""
    vocabulary = S.shared(terms.select("term").distinct(), "vocabulary")
    kind = T.chunk_type(F.coalesce("text", F.lit("")))
    rows = chunks.select("chunk_id", F.when(kind == "financial_metric", 1).when(kind == "risk_signal", 2).otherwise(0).alias("kind"), T.tokens(F.col("text")).alias("words"))
    entries = S.closed_entries(rows, "chunk_id", vocabulary)
    if not _distinct(entries, "chunk_id"):
        return None
    weighed = terms.select("query_id", "term", F.col("weight").cast("double").alias("weight"), F.col("n").cast("double").alias("n"), (F.col("m").cast("int") + F.col("r").cast("int") * 2).alias("kinds"))
    return S.best_of_tasks(weighed, entries, "chunk_id", k, vocabulary, lambda tf, dl: tf, most=1.0, bonus=0.15)


def lexical_search(queries: DataFrame, chunks: DataFrame, k: int = 10, scopes: Scopes | None = None, **pruning) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best chunks by ``lexical_scores``, those of a query's
    scopes only (tables (query_id, scope) and (chunk_id, scope)), without scoring all that share a
    frequent token."""
    q = written(closed_queries(queries), "query-terms")
    if not pruning and scopes is None and q.count() <= S.MOST_TERMS:
        best = _lexical_in_tasks(q.where("term is not null"), chunks, k)
        if best is not None:
            return top_k(best.withColumn("score", F.round("score", 4)), k, tie="chunk_id").withColumnRenamed("top_rank", "rank")
    post = written(closed_postings(q, chunks), "closed-postings")
    terms = q.where("term is not null").select("query_id", "term", (F.col("weight") / F.col("n")).alias("weight"))
    inside = scoped(post, scopes and scopes[1], "chunk_id", "chunk_id").select("scope", "term", F.col("chunk_id").alias("key"), F.lit(1.0).alias("impact"))
    found = found_in(scoped(terms, scopes and scopes[0], "query_id", "query_id"), inside, k, scopes is not None, more=0.15, most=1.0, **pruning)
    kinds = written(found, "lexical-pairs").withColumnRenamed("key", "chunk_id").hint("merge").join(post.select("chunk_id", "chunk_type").distinct(), "chunk_id")
    rows = kinds.hint("merge").join(q.select("query_id", "m", "r").distinct(), "query_id")
    scores = rows.select("query_id", "chunk_id", F.round(F.least(F.lit(1.0), F.col("score") + _type_bonus()), 4).alias("score"))
    return top_k(scores, k, tie="chunk_id").withColumnRenamed("top_rank", "rank")


FACT = "struct<metric:string,value:string,scope:string,row_label:string,source:string,alias:string>"


def asked_metrics(queries: DataFrame, metrics: DataFrame) -> DataFrame:
    """(query_id, metric) where a query's lower-case text names a metric: by its aliases, or else by its
    name. Names are looked for at their first four characters, by equal keys."""
    known = F.filter(F.array(*(F.when(T.asks_for(F.col("query_text"), F.lit(name)), F.lit(name)) for name, _ in T.METRIC_ALIASES)), lambda m: m.isNotNull())
    by_alias = queries.select("query_id", F.explode(known).alias("metric"))
    names = metrics.where(~F.col("metric").isin(*(name for name, _ in T.METRIC_ALIASES))).withColumn("name", F.replace("metric", F.lit("_"), F.lit(" ")))
    names = names.withColumn("start", F.substring("name", 1, 4))
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("query_text")))
    starts = F.array_distinct(F.flatten(F.transform(F.array(*map(F.lit, range(1, 5))), lambda size: F.transform(at, lambda i: F.substring(F.col("query_text"), i, size)))))
    by_name = queries.select("query_id", "query_text", F.explode(starts).alias("start")).hint("merge").join(names, "start").where(F.contains("query_text", "name"))
    return by_alias.unionByName(by_name.select("query_id", "metric")).distinct()


def keyword_scores(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score): ``lexical_scores`` for chunks (chunk_id, text, fact FACT) that may
    carry a financial fact. Where a numeric query asks for the fact's metric, the score is lifted to a
    floor and rewarded for a value, its scope, a total (in its row's label, or else its alias) and a
    table; where it asks for another, it is cut. Candidates share a token or the metric asked for; a
    chunk with neither scores at most 0.15 by its type alone and is left out. The text isn't carried:
    tokens, facts and ids move."""
    q = written(closed_queries(queries), "query-terms")
    had = chunks.select("fact.*").columns
    fact = F.when(F.col("fact").isNotNull(), F.struct(*((F.col(f"fact.{c}") if c in had else F.lit(None)).cast("string").alias(c) for c in ("metric", "value", "scope", "row_label", "source", "alias")))).cast(FACT)
    c = written(chunks.select("chunk_id", "text", T.chunk_type(F.coalesce("text", F.lit(""))).alias("chunk_type"), fact.alias("fact")).drop("text"), "chunk-facts")
    token = q.select("query_id", "term", "weight").hint("merge").join(closed_postings(q, chunks), "term").select("query_id", "chunk_id", F.col("weight").alias("one"))
    heads = written(q.select("query_id", "query_text", "n", "m", "r", "numeric").distinct(), "query-heads")
    with_fact = c.where("fact.metric <> ''").select("chunk_id", F.col("fact.metric").alias("metric"))
    asked = written(asked_metrics(heads.where("numeric"), with_fact.select("metric").distinct()), "asked")
    by_fact = asked.hint("merge").join(with_fact, "metric").select("query_id", "chunk_id", F.lit(0).alias("one"))
    common = written(token.unionByName(by_fact).groupBy("query_id", "chunk_id").agg(F.sum("one").alias("common")), "candidates")
    rows = common.hint("merge").join(c, "chunk_id").hint("merge").join(heads, "query_id").withColumn("metric", F.col("fact.metric"))
    rows = rows.hint("merge").join(asked.withColumn("right", F.lit(True)), ["query_id", "metric"], "left")
    over = F.when(F.col("n") > 0, F.col("common") / F.col("n")).otherwise(0.0) + F.when((F.col("chunk_type") == "financial_metric") & F.col("m"), 0.15).otherwise(0.0)
    scope = F.when(F.lower("fact.scope") == "consolidated", 0.22).when(F.lower("fact.scope") == "segment", 0.02).otherwise(0.0)
    label = F.lower(F.coalesce(F.nullif(F.col("fact.row_label"), F.lit("")), F.col("fact.alias"), F.lit("")))
    reward = 0.4 + F.when(F.coalesce("fact.value", F.lit("")) != "", 0.1).otherwise(0.0) + scope + F.when(label.contains("total"), 0.08).otherwise(0.0) + F.when(F.col("fact.source") == "html_table", 0.05).otherwise(0.0)
    financial = F.when(~F.col("numeric") | (F.coalesce("metric", F.lit("")) == ""), over).when(F.col("right"), F.greatest(over, F.lit(0.55)) + reward).otherwise(over * 0.35)
    total = financial + F.when((F.col("chunk_type") == "risk_signal") & F.col("r"), 0.15).otherwise(0.0)
    return rows.where((F.col("common") > 0) | F.col("fact").isNotNull()).select("query_id", "chunk_id", F.round(F.least(F.lit(1.0), total), 4).alias("score")).where("score > 0")


MODES = ("bm25", "dense", "hybrid", "hybrid_rerank")


def retrieve(modes, queries: DataFrame, docs: DataFrame, vectors: DataFrame, k: int = 10, candidates: int = 30, weights: dict[str, float] | None = None, in_scope: DataFrame | None = None, scopes: Scopes | None = None) -> DataFrame:
    """(mode, query_id, rank, doc_id, score) of each of MODES that is asked for, for queries (query_id,
    text, embedding), docs (doc_id, text) and vectors (doc_id, embedding). Both channels are searched
    once, as deep as the deepest mode needs; hybrid lists are fused by reciprocal rank, one channel
    stands for both where the other is empty, and reranking is by overlap. ``scopes``, two tables
    (query_id, scope) and (doc_id, scope), narrow each query to the documents of its scopes, its
    company's for instance, before anything is ranked; ``in_scope`` (query_id, doc_id) names them one
    by one. Without either the whole corpus is searched."""
    from quarry.operators.ranking import fuse

    if unknown := set(modes) - set(MODES):
        raise ValueError(f"no such mode: {sorted(unknown)}")
    deep = max(k, candidates) if "hybrid_rerank" in modes else k
    if in_scope is not None:
        scopes = (queries.select("query_id", F.col("query_id").alias("scope")), in_scope.select("doc_id", F.col("query_id").alias("scope")))
    found = {}
    if set(modes) - {"dense"}:
        found["bm25"] = bm25(queries, docs, deep, scopes=scopes)
    if set(modes) - {"bm25"}:
        named = scopes and (scopes[0], scopes[1].withColumnRenamed("doc_id", "vec_id"))
        found["dense"] = cosine_top_k(queries.select("query_id", "embedding"), vectors.select(F.col("doc_id").alias("vec_id"), "embedding"), deep, scopes=named).withColumnRenamed("vec_id", "doc_id")
    found = {m: written(d.select("query_id", "rank", "doc_id", "score"), m) for m, d in found.items()}
    out = [found[m].where(F.col("rank") <= k).withColumn("mode", F.lit(m)) for m in modes if m in found]
    for mode in (m for m in modes if m.startswith("hybrid")):
        d = deep if mode == "hybrid_rerank" else k
        both = found["bm25"].withColumn("mode", F.lit("bm25")).unionByName(found["dense"].withColumn("mode", F.lit("dense"))).where(F.col("rank") <= d)
        fused = fuse(both.withColumnRenamed("doc_id", "chunk_id"), weights).where(F.col("rank") <= d).select("query_id", "rank", F.col("chunk_id").alias("doc_id"), F.col("fusion_score").alias("score"))
        if mode == "hybrid_rerank":
            pool = written(fused, "pool")
            words = documents_of(pool, docs).select("doc_id", T.tokens(F.col("text")).alias("text_tokens"), T.chunk_type(F.coalesce("text", F.lit(""))).alias("chunk_type"))
            rows = pool.withColumn("retrieval_method", F.lit("hybrid_rrf")).hint("merge").join(words, "doc_id").hint("merge").join(queries.select("query_id", T.tokens(F.col("text")).alias("query_tokens")), "query_id")
            fused = lexical_rerank(rows, k).select("query_id", F.col("new_rank").alias("rank"), "doc_id", F.col("rerank_score").alias("score"))
        out.append(fused.withColumn("mode", F.lit(mode)))
    columns = ("mode", "query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")
    first, *rest = [d.select(*columns) for d in out]
    for d in rest:
        first = first.unionByName(d)
    return first


def candidate_faults(hits: DataFrame, corpus: DataFrame, cases: DataFrame, most: int) -> DataFrame:
    """(query_id, reason) of every case (query_id, company): ``ok``, or the first rule that its hits
    (query_id, chunk_id, doc_id, companies) break: some, at most ``most``, each with an id of its own,
    from the corpus (doc_id), and of the case's company."""
    known = hits.hint("merge").join(corpus.select("doc_id", F.lit(True).alias("known")).dropDuplicates(["doc_id"]), "doc_id", "left")
    rows = cases.hint("merge").join(known, "query_id", "left")
    blank = F.trim(F.coalesce(F.col("chunk_id").cast("string"), F.lit(""))) == ""
    seen = rows.groupBy("query_id").agg(
        F.count("doc_id").alias("n"),
        F.count_if(F.col("doc_id").isNotNull() & blank).alias("blank"),
        F.count_distinct("chunk_id").alias("n_ids"),
        F.count("chunk_id").alias("n_chunks"),
        F.count_if(F.col("doc_id").isNotNull() & F.col("known").isNull()).alias("outside"),
        F.count_if(F.col("doc_id").isNotNull() & ~F.coalesce(F.array_contains("companies", F.col("company")), F.lit(False))).alias("foreign"),
    )
    reason = (
        F.when(F.col("n") == 0, "no_candidates")
        .when(F.col("n") > most, "too_many")
        .when((F.col("blank") > 0) | (F.col("n_ids") < F.col("n_chunks")), "missing_or_duplicate_chunk")
        .when(F.col("outside") > 0, "outside_corpus")
        .when(F.col("foreign") > 0, "cross_company")
        .otherwise("ok")
    )
    return seen.select("query_id", reason.alias("reason"))


def rerank_faults(final: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """(query_id, reason) of reranked hits (query_id, chunk_id) against the pool they came from: some if
    the pool has any, at most ``k``, all from the pool, none twice."""
    inside = pool.select("query_id", "chunk_id", F.lit(True).alias("inside")).distinct()
    got = final.hint("merge").join(inside, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("n_ids"), F.count_if(F.col("inside").isNull()).alias("outside"))
    rows = pool.select("query_id").distinct().hint("merge").join(got, "query_id", "full")
    reason = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "no_hits")
        .when(F.col("n") > k, "too_many")
        .when(F.col("outside") > 0, "outside_pool")
        .when(F.col("n_ids") < F.col("n"), "duplicate_chunk")
        .otherwise("ok")
    )
    return rows.select("query_id", reason.alias("reason"))


def paragraph_search(queries: DataFrame, docs: DataFrame, k: int = 5, snippet: int = 400) -> DataFrame:
    """(query_id, doc_id, paragraph, score, snippet, rank): the k paragraphs with the largest share of a
    query's tokens; one that the query, trimmed, stands in has all of 1.0. Where the queries have few
    tokens, paragraphs are scored in the tasks that read them (``task_scores``); else those that share a
    token are. Only the documents that are shown are read again."""
    from quarry.operators.chunking import paragraphs

    parts = docs.select("doc_id", F.posexplode(paragraphs(F.coalesce("text", F.lit("")))).alias("paragraph", "body"))
    q = written(queries.select("query_id", T.tokens(F.col("text")).alias("t")).select("query_id", F.size("t").alias("n"), F.explode("t").alias("term")), "query-tokens")
    if q.count() <= S.MOST_TERMS and _distinct(docs, "doc_id"):
        vocabulary = S.shared(q.select("term").distinct(), "vocabulary")
        place = F.struct("doc_id", "paragraph").alias("place")
        entries = S.token_entries(parts.select(place, F.lit(0).alias("kind"), T.tokens(F.col("body")).alias("words")), "place", vocabulary)
        weighed = q.select("query_id", "term", F.lit(1.0).alias("weight"), F.col("n").cast("double").alias("n"), F.lit(0).alias("kinds"))
        best = S.best_of_tasks(weighed, entries.where(F.size("ids") > 0), "place", k, vocabulary, lambda tf, dl: tf)
        shares = best.select("query_id", "place.doc_id", "place.paragraph", F.round("score", 4).alias("score"))
    else:
        p = wanted_terms(q, parts.select("doc_id", "paragraph", F.explode(T.tokens(F.col("body"))).alias("term")))
        scored = q.hint("merge").join(p, "term").groupBy("query_id", "n", "doc_id", "paragraph").agg(F.count("*").alias("common"))
        shares = scored.select("query_id", "doc_id", "paragraph", F.round(F.col("common") / F.col("n"), 4).alias("score"))
    bodies = parts.select(F.struct("doc_id", "paragraph").alias("doc_id"), "body")
    inside = containing(queries.select("query_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "").alias("passage")), bodies).select("query_id", "doc_id.doc_id", "doc_id.paragraph", F.lit(1.0).alias("score"))
    best = shares.unionByName(inside).groupBy("query_id", "doc_id", "paragraph").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "paragraph")
    best = written(best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k), "best-paragraphs")
    shown = documents_of(best, docs, "doc_id").select("doc_id", F.posexplode(paragraphs(F.coalesce("text", F.lit("")))).alias("paragraph", "body"))
    return best.hint("merge").join(shown.select("doc_id", "paragraph", F.substring("body", 1, snippet).alias("body")), ["doc_id", "paragraph"]).select("query_id", "doc_id", "paragraph", "score", F.substring("body", 1, snippet).alias("snippet"), "rank")


def containing(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, doc_id) of passages (query_id, passage) that stand in texts (doc_id, body), both
    squeezed. The first and last word of a passage may be parts of longer ones in a text, so those
    between them, four at most, are its key. Keys, then the documents that have one, are broadcast if
    there are at most BROADCAST_ROWS of them, and the passage itself is looked for in those documents
    alone; more of them are shuffled. Passages of one or two words have no key; every text is searched
    for those."""
    p = written(passages.where("passage <> ''").withColumn("w", F.split("passage", " ")).withColumn("k", F.least(F.lit(4), F.size("w") - 2)), "passages")
    lengths = [r.k for r in p.where("k > 0").select("k").distinct().collect()]  # 1 to 4
    key = lambda ws, i, k: F.xxhash64(F.lit(k), F.array_join(F.slice(ws, i, k), " "))
    out = None
    few = lambda rows: rows.count() <= BROADCAST_ROWS
    met = lambda rows, small, on, how="inner": rows.join(F.broadcast(small), on, how) if few(small) else rows.hint("merge").join(small, on, how)
    if lengths:
        mine = F.lit(None).cast("long")
        for k in lengths:
            mine = F.when(F.col("k") == k, key(F.col("w"), 2, k)).otherwise(mine)
        wanted = written(p.where("k > 0").select("query_id", mine.alias("key")), "keys")
        ws = F.split("body", " ")
        of_length = lambda k: F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(1), F.size("w") - (k - 1)), lambda i: key(F.col("w"), i, k))).otherwise(F.array().cast("array<bigint>"))
        every = F.array_distinct(F.concat(*map(of_length, lengths)))
        keys = texts.withColumn("w", ws).select("doc_id", F.explode(every).alias("key"))
        near = written(met(keys, wanted, "key").select("query_id", "doc_id").distinct(), "near")
        rows = met(texts, near, "doc_id")
        rows = met(rows, p.where("k > 0").select("query_id", "passage"), "query_id")
        out = rows.where(F.contains("body", "passage")).select("query_id", "doc_id")
    short = p.where("k <= 0").select("query_id", "passage")
    found = texts.join(F.broadcast(short) if few(short) else short, F.contains("body", "passage")).select("query_id", "doc_id")
    return found if out is None else out.unionByName(found)


def lexical_rerank(hits: DataFrame, k: int = 10) -> DataFrame:
    """0.85 overlap + 0.15 prior, ties by the former rank. ``hits`` has query_tokens and text_tokens, both
    closed under synonyms here; where it has chunk_type, 0.12 is added to the overlap of a metric or risk
    chunk that the query asks for, and where it has retrieval_method, 0.03 for a fused one. A query
    of no tokens scores 0."""
    q, t = T._bound(F.col("query_tokens"), T.expand_synonyms), T._bound(F.col("text_tokens"), T.expand_synonyms)
    rows = hits.withColumns({"_q": q, "_t": t})
    over = T.overlap(F.col("_q"), F.col("_t"))
    if "chunk_type" in hits.columns:
        kind = F.coalesce("chunk_type", F.lit("narrative"))
        over = over + F.when((kind == "financial_metric") & T.holds(F.col("_q"), T.RERANK_METRIC_WORDS), 0.12).when((kind == "risk_signal") & T.holds(F.col("_q"), T.RERANK_RISK_WORDS), 0.12).otherwise(0.0)
    if "retrieval_method" in hits.columns:
        over = over + F.when(F.coalesce("retrieval_method", F.lit("")).contains("rrf"), 0.03).otherwise(0.0)
    prior = F.least(F.lit(1.0), F.when(F.col("score") <= 1.0, F.col("score")).otherwise(F.col("score") / 10.0))
    score = F.when(F.size("_q") > 0, F.least(F.lit(1.0), over * 0.85 + prior * 0.15)).otherwise(0.0)
    rows = rows.withColumn("rerank_score", F.round(score + TIE, 4)).drop("_q", "_t")
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return rows.withColumn("new_rank", F.row_number().over(order).cast("long")).where(F.col("new_rank") <= k)


def checked_rerank(scores: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, reason): whether returned scores (query_id, position, index, score) can be used:
    as many as expected, distinct indices, scores in [0, 1] and not rising."""
    order = Window.partitionBy("query_id").orderBy("position")
    rows = scores.withColumn("before", F.lag("score").over(order))
    got = rows.groupBy("query_id").agg(
        F.count("*").alias("n"), F.count_distinct("index").alias("n_index"), F.bool_or((F.col("score") < 0) | (F.col("score") > 1)).alias("outside"), F.bool_or(F.col("score") > F.col("before")).alias("rising")
    )
    reason = (
        F.when(F.coalesce("n", F.lit(0)) != F.col("n_expected"), "count")
        .when(F.col("n_index") != F.col("n"), "duplicate_index")
        .when(F.col("outside"), "out_of_range")
        .when(F.coalesce("rising", F.lit(False)), "not_descending")
        .otherwise("ok")
    )
    return expected.join(got, "query_id", "left").select("query_id", reason.alias("reason"))


def retrieval_policy(channel_counts: DataFrame) -> DataFrame:
    """(query_id, mode, degraded) from (query_id, n_dense, n_bm25): both channels are fused, one
    stands alone, none falls back to lexical search."""
    d, b = F.col("n_dense") > 0, F.col("n_bm25") > 0
    return channel_counts.select("query_id", F.when(d & b, "hybrid_rrf").when(d, "dense").when(b, "bm25").otherwise("lexical_fallback").alias("mode"), (~(d & b)).alias("degraded"))
