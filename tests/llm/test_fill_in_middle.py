import hashlib
import re

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm.fill_in_middle import SQL, Units, fill_in_middle, op13_fill_in_middle, restored
from tests.llm.conftest import EDGE

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
BYTES = "".join(map(chr, [*range(1, 16), 28, 31, 32, 33, 127, 0x85, 0xA0, 0x2003, 0x20AC, 0x1F600])) + "ab  "


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=BYTES, max_size=40), min_size=1, max_size=5))
def test_ends_of_units_are_those_of_the_pattern(texts):
    coded = [t.encode() for t in texts]
    units = Units(np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)]))
    found = [UNIT.findall(t) for t in texts]
    assert units.n.tolist() == [len(u) for u in found]
    for i, parts in enumerate(found):
        ends = units.end_of(np.full(len(parts) + 1, i), np.arange(len(parts) + 1))
        assert ends.tolist() == [len("".join(parts[:k]).encode()) for k in range(len(parts) + 1)]


def expected(doc_id, text, percent=50):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    units = UNIT.findall(text)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= percent:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


MORE = [(i, f" a<\n{'b' * i} <P é\x85  c{i}S>  " * (i % 4)) for i in range(20, 80)] + [(90, "holds <M> itself"), (91, "<S"), (92, " "), (93, "\x0b\x1c"), (-5, "minus five")]


def test_against_brute_force(spark, docs):
    for rows, percent in ((EDGE + MORE, 50), (EDGE + MORE, 100), (EDGE[:1], 100)):
        got = fill_in_middle(docs(rows).repartition(3), percent=percent)
        got = got.withColumn("back", restored(F.col("form"), F.col("output"))).collect()
        key = lambda r: (str(r[0]), r[1], str(r[5]))
        assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((expected(d, t, percent) for d, t in rows), key=key)
        assert sorted((str(r.doc_id), r.back) for r in got) == sorted((str(d), t or "") for d, t in rows)
    assert fill_in_middle(docs([])).count() == 0


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = duck.execute(SQL)
    names = [d[0] for d in want.description]
    got = op13_fill_in_middle(spark, sf).select(*names).collect()
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)
