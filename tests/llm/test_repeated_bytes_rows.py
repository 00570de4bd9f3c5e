from datetime import date, datetime
from decimal import Decimal

from quarry.llm.repeated_bytes import without_repeats

SCHEMA = "seen timestamp, doc_id long, carry string, day date, price decimal(20,6), ratio double, raw binary, tags array<string>, more map<string,array<long>>, at struct<tie:long,a:timestamp>, text string, n_chars long"


def row(doc_id, text, n=None):
    at = datetime(2024, 5, 17, 3, 4, 5, 123456 + (doc_id or 0))
    return (at, doc_id, "c", date(1999, 1, 2), Decimal("12345678901234.000001"), 0.1 + 0.2, b"\x00\xff", ["a", None, ""], {"k": [1, None], "": None}, (doc_id, at), text, n)


def test_all_types_and_nulls_stay(spark):
    text = "0123456789" * 9 + "abcdefghijklmnopqrstuvwxyz" * 3
    rows = [row(1, text, len(text)), row(2, "tail " + text, 1), row(3, None, 7), row(4, "", 0), row(None, None), row(3, None, 7), (None,) * 12]
    got = without_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in spark.createDataFrame([], SCHEMA).schema]
    want = [r if r[1] != 2 else (*r[:10], "tail ", 5) for r in rows]
    key = lambda r: repr(tuple(r))
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((tuple(r) for r in spark.createDataFrame(want, SCHEMA).collect()), key=key)


def test_no_other_columns(spark):
    got = without_repeats(spark.createDataFrame([("x" * 300, 1), (None, 2), ("x" * 120, 3)], "text string, doc_id long"))
    assert sorted(map(tuple, got.collect()), key=repr) == [("x", 1), (None, 2)]  # the string at each later place starts earlier
