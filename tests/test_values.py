import pytest
from pyspark.sql import functions as F

from quarry.functions import values as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"b": 1, "a": {"d": [2, 1], "c": null}}', '{"a":{"c":null,"d":[2,1]},"b":1}'),
        ('so ```json\n{"b":1,"a":2}\n``` {x}', '{"a":2,"b":1}'),
        ('```\nno json\n``` but {"é": "ü \\" }"}', '{"é":"ü \\" }"}'),
        ("{broken", None),
        ('{"a":1} and {"b":2}', '{"a":1}'),
        ("", None),
        (None, None),
    ],
)
def test_payload(spark, text, want):
    assert one(spark, V.canonical_json(V.payload(F.lit(text).cast("string")))) == want


@pytest.mark.parametrize("text, want", [("a.md#p12", (True, "a.md", 12)), ("a#b#p1", (True, "a#b", 1)), ("#p1", (False, None, None)), ("a#p", (False, None, None)), ("a#p1x", (False, None, None)), (f"a#p{10**30}", (False, None, None)), (None, (False, None, None))])
def test_citation(spark, text, want):
    assert tuple(one(spark, V.citation(F.lit(text).cast("string")))) == want


def test_sound_numbers(spark):
    assert [one(spark, V.sound(F.lit(x))) for x in (1, "2.5", "x", float("nan"), float("inf"), None)] == [1.0, 2.5, None, None, None, None]
    near = lambda a, b: one(spark, V.close_to(F.lit(a), F.lit(b)))
    assert near(100.0, 100.9) and not near(100.0, 102.0) and near(0.0, 0.0) and not near(float("nan"), float("nan")) and not near(None, 1.0)
