import hashlib

import pytest
from pyspark.sql import functions as F

from quarry.operators import ranking as R
from quarry.operators.groups import ordered_digests, ranked_in_groups, values_at


def test_ranks_and_values_of_a_hot_group(spark):
    rows = [("hot", i * 7919 % 2000, i) for i in range(2000)] + [("one", 5, 1)] + [("two", 3, 1), ("two", 3, 0)]
    df = spark.createDataFrame(rows, "g string, v long, id long").repartition(5)
    order = {g: sorted((v, i) for k, v, i in rows if k == g) for g in ("hot", "one", "two")}
    assert all(order[r.g][r.nth] == (r.v, r.id) for r in ranked_in_groups(df, ["g"], ["v", "id"]).collect())
    got = values_at(df, ["g"], ["v", "id"], "v", low=F.lit(0), high=F.col("n") - 1, mid=F.floor(F.col("n") / 2)).collect()
    assert {r.g: (r.low, r.mid, r.high) for r in got} == {g: (o[0][0], o[len(o) // 2][0], o[-1][0]) for g, o in order.items()}


def test_ordered_digest(spark):
    rows = [("a", f"id{i % 5000}") for i in range(9000)] + [("b", "x"), ("b", None), ("é|", "ü"), ("é|", "z")]
    got = {r.g: (r.n_ids, r.fingerprint) for r in ordered_digests(spark.createDataFrame(rows, "g string, id string").repartition(4), ["g"], "id").collect()}
    for g in ("a", "b", "é|"):
        ids = sorted({i.encode() for k, i in rows if k == g and i})
        assert got[g] == (len(ids), hashlib.sha256(b"\n".join(ids)).hexdigest())
    assert len(got) == 3 and ordered_digests(spark.createDataFrame([], "g long, id long"), ["g"], "id").dtypes[0] == ("g", "bigint")


@pytest.mark.parametrize("n", [0, 1, 37])
def test_bootstrap_draws(spark, n):
    values = spark.createDataFrame([(i, float(i * i), None if i == 3 else 1.0 * i) for i in range(n)], "position long, a double, b double")
    draw = lambda b, i: int(hashlib.md5(f"7-{b}-{i}".encode()).hexdigest()[:12], 16) % n
    want = {}
    for b in range(20 if n else 0):
        at = [draw(b, i) for i in range(n)]
        some = [x for x in at if x != 3]
        want[b] = (sum(x * x for x in at) / n, sum(some) / len(some))
    for most in (10**6, 0):
        got = {r.resample: (r.a, r.b) for r in R.bootstrap_means(values, 20, 7, "a", "b", most=most).collect()}
        assert got.keys() == want.keys() and all(got[b] == pytest.approx(want[b]) for b in want)


def test_resamples_are_summed_where_they_are_drawn(spark):
    plan = R.bootstrap_means(spark.range(1000).select(F.col("id").alias("position"), F.rand(1).alias("x")), 50, 1, "x")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_small_groups_are_sorted_each_by_itself(spark, monkeypatch):
    from quarry.operators import groups as G

    ranges, number = [], G.numbered
    monkeypatch.setattr(G, "numbered", lambda *a, **b: ranges.append(a) or number(*a, **b))
    df = spark.createDataFrame([(i % 7, (i * 13) % 10 if i % 9 else None, i) for i in range(200)], "g long, v long, id long")
    rows = lambda: sorted(tuple(r) for r in ranked_in_groups(df, ["g"], ["v", "id"]).select("g", "id", "nth").collect())
    got = rows()
    assert not ranges
    monkeypatch.setattr(G, "FEW_ROWS", 10)
    assert rows() == got and ranges
