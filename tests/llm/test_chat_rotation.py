from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from quarry.llm.chat_rotation import SQL, op7_chat_rotation, rotate

ROWS = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi"), (1, 2, "bob", "<|end|> hi"), (1, 3, "ann", None), (1, 3, "cy", ""), (1, 3, "cy", ""), (2, None, None, "x"), (2, 0, "ann", "y"), (None, 0, "ann", "é" * 5000), (3, 0, "system", "alone")]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_renderings(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(1) for c in ("start", "size", "part", "conv", "speaker")})
    got = rotate(df.repartition(4)).collect()
    assert {(r.conv_id, r.perspective) for r in got} == {(1, "ann"), (1, "bob"), (1, "cy"), (2, "unknown"), (2, "ann"), (None, "ann")}
    by = defaultdict(list)
    for r in got:
        by[r.conv_id, r.perspective].append(r)
    for (conv, person), rows in by.items():
        rows.sort(key=lambda r: r.message)
        whole = "".join(r.segment for r in rows)
        assert [r.message for r in rows] == list(range(len(rows)))
        assert all(whole[r.start : r.end] == r.segment for r in rows)
        trained = [whole[r.mask_start : r.mask_end] for r in rows if r.mask_start is not None]
        turns = sorted(((t is not None, t or 0, s or "unknown", (x or "").replace("<|", "< |")) for c, t, s, x in ROWS if c == conv))
        assert trained == [x + "<|end|>" for *_, s, x in turns if s == person]
        assert whole.count("<|end|>") == len(rows)


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = duck.execute(SQL)
    names = [d[0] for d in want.description]
    got = op7_chat_rotation(spark, sf).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


def test_empty(spark):
    assert rotate(spark.createDataFrame([], SCHEMA)).count() == 0
