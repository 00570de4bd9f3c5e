import re

import numpy as np

from quarry.operators.retrieval import cosine_top_k


def test_vectors_stay_where_they_are_read(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8 if i % 5 else 6).tolist()) for i in range(300)] + [(300, None), (301, []), (302, [0.0] * 8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).write.parquet(f"{tmp_path}/v")
    vectors = spark.read.parquet(f"{tmp_path}/v")
    found = cosine_top_k(vectors.where("vec_id % 7 = 0").withColumnRenamed("vec_id", "query_id"), vectors, k=4, block=16)
    want = set()
    for q, a in rows[:300:7]:
        near = [(-round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 4), v) for v, b in rows[:300] if len(b) == len(a)]
        want |= {(q, v, -s, rank) for rank, (s, v) in enumerate(sorted(near)[:4], 1)}
    got = {(r.query_id, r.vec_id, round(r.score, 4), r["rank"]) for r in found.collect()}
    assert got == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and set(re.findall(r"hashpartitioning\((\w+?)#", plan)) == {"query_id"}


def test_no_queries(spark):
    vectors = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert cosine_top_k(vectors.limit(0).withColumnRenamed("vec_id", "query_id"), vectors).count() == 0
