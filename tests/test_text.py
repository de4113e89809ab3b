import pytest
from pyspark.sql import functions as F

from tidewash.functions import text as X


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "value", ["  a b ", "\t\nx\x1c", " y ", "", "   ", None, "inner  gap", "　"]
)
def test_strip_like_python(spark, value):
    expected = None if value is None else value.strip()
    assert one(spark, X.strip, value) == expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("  Hello, World - x ", "hello_world_x"),
        ("__A__", "a"),
        ("Café  Été!", "café_été"),
        ("--", ""),
        (None, None),
    ],
)
def test_slug(spark, value, expected):
    assert one(spark, X.slug, value) == expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        (" 12 ", 12.0),
        ("1_000", 1000.0),
        ("_1", None),
        ("1__0", None),
        ("-3e2", -300.0),
        (".5", 0.5),
        ("5.", 5.0),
        ("1.5d", None),
        ("1f", None),
        ("Infinity", float("inf")),
        ("-inf", float("-inf")),
        ("nan", None),
        ("", None),
        ("abc", None),
        ("1 2", None),
        (None, None),
    ],
)
def test_to_number(spark, value, expected):
    assert one(spark, X.to_number, value) == expected


def test_counts(spark):
    assert one(spark, X.comma_count, "a,b,,c") == 3
    assert one(spark, X.word_count, "  one two\tthree ") == 3
    assert one(spark, X.word_count, "   ") == 0
    assert one(spark, X.token_count, "usa, canada") == 3
    assert one(spark, X.has_digit, "type 1") is True


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("english|welsh", "welsh, english", True),
        ("English / Welsh", "welsh,english", True),
        ("usa, canada", "canada", False),
        ("level 1", "level 2", False),
        ("english, english", "english", False),
    ],
)
def test_canonical_list(spark, a, b, same):
    got = one(spark, X.canonical_list, a) == one(spark, X.canonical_list, b)
    assert got is same
