import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.llm.toxicity import KINDS, Lexicon, compose, features, learn, match, op8_toxicity, score, Transducer
from tests.llm.conftest import EDGE


def kinds(text):
    f = features(pa.array([text]), Lexicon.built_in())[0]
    return {k: int(n) for k, n in zip(KINDS, f) if n}


def test_grammar():
    assert kinds("What a stupid plan") == {"insult": 1}
    assert kinds("You are an idiot.") == {"directed insult": 1}
    assert kinds("idiot, you there") == {"insult": 1}  # another clause
    assert kinds("such a moron are you") == {"directed insult": 1}
    assert kinds("You are not an idiot.") == {"negated": 1}
    assert kinds("He said you are an idiot!") == {"reported": 1}
    assert kinds("I will kill you") == {"directed threat": 1}
    assert kinds("idiot trash clown scum loser") == {"insult": 3}
    assert kinds("nothing here; at all") == {}
    assert match([]) == []


def test_composition_is_running_one_after_the_other():
    a = Transducer(0, {(0, "x"): (1, ("y", "y")), (1, "x"): (0, ())}, {})
    b = Transducer(0, {(0, "y"): (1, ("z",))}, {})
    c = compose(a, b, ("x", "w"))
    state, out = c.start, []
    for s in "xwxx":
        state, o = c.step(state, s)
        out += o
    assert out == ["z", "y", "w", "y", "y"]


def test_learned_beginnings(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        words = [f"w{rng.integers(0, 500)}" for _ in range(30)]
        if i % 5 == 0:
            words[7] = "blorg" + "".join(rng.choice(list("abcdefgh"), 4))
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumns({"n": F.lit("x"), "kind": F.lit("y")})
    got = score(spark.createDataFrame([(1, "a blorgzzz b"), (2, "a b"), (3, None)], "doc_id long, text string"), learn(df, df)).collect()
    assert [r.predicted for r in sorted(got)] == [1, 0, 0]


def test_edges(spark, docs):
    labels = docs([]).withColumn("toxic", F.lit(1))
    got = score(docs(EDGE).select("doc_id", "text"), learn(docs(EDGE), labels)).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score < 0.5 for r in got)
    assert score(docs([]).select("text"), learn(docs([]), labels)).count() == 0


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = op8_toxicity(spark, sf).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    a, b = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    auc = np.mean([(x > y) + 0.5 * (x == y) for x in a for y in b])
    print(auc, len(a), len(b), sum(r.predicted for r in rows if r.toxic) / len(a))
    assert auc > 0.9 and sum(r.predicted for r in rows if not r.toxic) <= 0.02 * len(b)
