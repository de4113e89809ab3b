from pyspark.sql import functions as F

from tidewash.operators import label as L


def symptoms(spark):
    rows = [("fever, cough",), ("cough",), (None,), (" rash ,fever",)]
    return spark.createDataFrame(rows, "s string")


def test_atomic_values(spark):
    got = [r["value"] for r in L.distinct_atomic_values(symptoms(spark), "s").collect()]
    assert got == ["cough", "fever", "rash"]


def test_first_rule_wins_and_null_stays_null(spark):
    rules = [("cough", "lungs"), ("fever", "general")]
    got = {r["s"]: r["s_Classified"] for r in L.label_by_rules(symptoms(spark), "s", rules).collect()}
    assert got == {"fever, cough": "lungs", "cough": "lungs", None: None, " rash ,fever": "general"}


def test_function_sees_each_value_once(spark):
    df = symptoms(spark).union(symptoms(spark))
    labelled = L.label_by_function(df, "s", lambda v: v.str.len().astype(str))
    assert labelled.count() == 8
    assert labelled.where("s is null and s_Classified is not null").isEmpty()
    assert labelled.where("s = 'cough' and s_Classified = '5'").count() == 2


def test_lookup_never_repeats_rows(spark):
    lookup = spark.createDataFrame([("cough", "b"), ("cough", "a")], "value string, label string")
    got = L.label_by_lookup(symptoms(spark), "s", lookup)
    assert got.count() == 4
    assert got.where("s = 'cough'").first()["s_Classified"] == "a"


def test_counts_and_top(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",), (None,)], "l string")
    assert [tuple(r) for r in L.label_counts(df, "l").collect()] == [("b", 2), ("a", 1), ("c", 1)]
    assert L.label_counts(df, "l", 2).agg(F.sum("count")).first()[0] == 3
