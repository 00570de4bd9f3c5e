import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators.entities import dedupe_across_companies

HITS = "company string, fingerprint string, tags array<string>, text string, score double, rank long"


def plain(hits):
    """The rule as windows over all hits of a fingerprint."""
    own = Window.partitionBy("fingerprint")
    alone = F.coalesce((F.size("tags") == 1) & (F.element_at("tags", 1) == F.col("company")), F.lit(False))
    rows = hits.withColumns({"alone": alone, "named": F.contains(F.lower("text"), F.lower("company"))}).withColumn("any_alone", F.max("alone").over(own))
    rows = rows.withColumn("winner", F.first("company").over(own.orderBy(F.desc("named"), F.desc("score"), "company")))
    first = Window.partitionBy("company", "fingerprint").orderBy("rank", "score")
    kept = rows.where("alone or (not any_alone and company = winner)").withColumn("nth", F.row_number().over(first))
    return kept.where("nth = 1").select("company", "fingerprint", "score", "rank")


def test_hits_of_a_fingerprint_are_aggregated(spark):
    dice = random.Random(5)
    names = ["a", "b", "cc", None]
    rows = []
    for i in range(3000):
        company = dice.choice(names)
        tags = [company] if dice.random() < 0.03 else ["x"] if dice.random() < 0.9 else None
        rows.append((company, dice.choice([None, *(f"f{j}" for j in range(150))]), tags, dice.choice([None, "on A", "on b", "cc"]), dice.choice([None, 1.0, 2.0, 2.5]), dice.choice([None, i, i, i])))
    hits = spark.createDataFrame(rows, HITS).repartition(4)
    got = dedupe_across_companies(hits)
    key = lambda r: tuple((x is not None, x) for x in r)
    # of several hits without a rank any may be first in the windows; here it is the least score, null last
    ranked = lambda found: sorted((tuple(r) if r.rank is not None else (r.company, r.fingerprint, None, None) for r in found.collect()), key=lambda r: str(key(r)))
    assert ranked(got) == ranked(plain(hits)) and got.count() > 100
    assert "Window" not in got._jdf.queryExecution().toString()
    many = spark.range(50_000).select(F.concat(F.lit("c"), F.col("id") % 3).alias("company"), F.lit("f").alias("fingerprint"), F.array(F.lit("x")).alias("tags"), F.lit("").alias("text"), F.col("id").cast("double").alias("score"), F.col("id").alias("rank"))
    assert [tuple(r) for r in dedupe_across_companies(many).collect()] == [("c1", "f", 1.0, 1)]
