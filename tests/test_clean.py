import pytest
from pyspark.sql import functions as F

from tidewash.functions.columns import column_kinds, nan_to_null, numeric_columns
from tidewash.operators import clean as C
from tidewash.operators import profile as P


def dirty(spark):
    rows = [
        (" A ", 1.0, None, "x"),
        ("a", 1.0, None, "X "),
        ("b", None, "  ", None),
        (None, None, None, None),
        ("c", 2.0, "n", ""),
        ("C", 2.0, "N", " "),
    ]
    return spark.createDataFrame(rows, "`First Name` string, v double, note string, Tag string")


def test_headers(spark):
    df = spark.createDataFrame([(1, 2)], "` First Name ` int, Other int")
    assert C.normalize_headers(df).columns == ["first_name", "other"]
    assert C.header_changes(df) == {" First Name ": "first_name", "Other": "other"}


def test_equal_headers_raise(spark):
    df = spark.createDataFrame([(1, 2)], "`a b` int, `a_b` int")
    with pytest.raises(ValueError, match="a_b"):
        C.normalize_headers(df)


def test_clean_counts_add_up_and_is_idempotent(spark):
    assert C.clean(dirty(spark), 70, 70).cols_dropped_sparse == []
    done = C.clean(dirty(spark), 70, 40)
    assert done.data.columns == ["first_name", "v"]
    assert done.rows_before == done.rows_after + done.duplicates_removed + done.rows_dropped_sparse
    assert (done.duplicates_removed, done.rows_dropped_sparse) == (2, 2)
    assert done.cols_dropped_sparse == ["note", "tag"]
    again = C.clean(done.data, 70, 70)
    assert again.duplicates_removed == again.rows_dropped_sparse == 0
    assert sorted(map(tuple, again.data.collect()), key=str) == sorted(
        map(tuple, done.data.collect()), key=str
    )


def test_blank_text_is_null_after_cleaning(spark):
    data = C.clean(dirty(spark), 70, 70).data
    assert data.where(F.col("tag") == "").isEmpty()
    assert data.where(F.col("tag").isNull()).count() == 1


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(None,) * 7 + (1, 2, 3)], ", ".join(f"c{i} int" for i in range(10)))
    assert C.drop_sparse_rows(df, 70).count() == 1
    assert C.drop_sparse_rows(df, 69.9).count() == 0
    rows = [(None, 1)] * 7 + [(1, 1)] * 3
    df = spark.createDataFrame(rows, "a int, b int")
    assert C.sparse_columns(df, 70) == []
    assert C.sparse_columns(df, 69) == ["a"]


def test_empty_table(spark):
    empty = dirty(spark).limit(0)
    done = C.clean(empty)
    assert (done.rows_before, done.rows_after, done.cols_dropped_sparse) == (0, 0, [])
    assert C.sparse_columns(empty) == []
    row = C.duplicate_stats(empty).first()
    assert (row["total_rows"], row["duplicate_rows"], row["duplicate_pct"]) == (0, 0, 0.0)
    assert P.missing_summary(empty).first()["missing_pct"] == 0.0


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert P.missing_summary(df).first()["missing_count"] == 1
    assert nan_to_null(df).where("x is null").count() == 1
    assert P.describe_dataset(df).first()["num_unique"] == 1


def test_numeric_rules(spark):
    df = spark.createDataFrame(
        [(1, 2, 1.0, True, "s")], "a int, b bigint, c double, d boolean, e string"
    )
    assert numeric_columns(df, "narrow") == ["b", "c"]
    assert numeric_columns(df, "wide") == ["a", "b", "c"]
    assert numeric_columns(df, "predicate") == ["a", "b", "c", "d"]
    assert numeric_columns(df, exclude=["b"]) == ["a", "c"]
    assert column_kinds(df)["e"] == "categorical"
    with pytest.raises(ValueError):
        numeric_columns(df, "other")


def test_large_whole_numbers_stay_apart(spark):
    big = 2**60
    df = spark.createDataFrame([(big,), (big + 1,)], "x bigint")
    assert P.describe_dataset(df).first()["num_unique"] == 2


def test_samples_are_repeatable_and_bounded(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("s"))
    first = P.describe_dataset(df, samples=3).first()["samples"]
    assert first == P.describe_dataset(df.repartition(7), samples=3).first()["samples"]
    assert len(first.split(" | ")) == 3


def test_identifier_columns_skip_empty_ones(spark):
    rows = [(str(i), "same", None) for i in range(20)]
    df = spark.createDataFrame(rows, "id string, k string, n string")
    assert [r["column"] for r in P.identifier_columns(df).collect()] == ["id"]


def test_modes_go_to_the_smallest_value(spark):
    df = spark.createDataFrame([(10.0,), (9.0,), (10.0,), (9.0,), (100.0,)], "x double")
    assert P.numeric_stats(df).first()["mode"] == 9.0


def test_duplicates_are_counted_by_content_not_by_hash(spark):
    # A null does not change a row's hash, so these two rows share theirs.
    rows = [("a", None), (None, "a"), ("a", None), ("b", "c"), ("b", "c"), ("b", "c")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert C.count_duplicates(df) == 3
    assert C.drop_duplicates(df).count() == 3
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),)], "x double")
    assert C.count_duplicates(zeros) == zeros.count() - zeros.dropDuplicates().count()


def test_many_columns(spark):
    wide = spark.range(5).select("id", *[F.lit(None).cast("int").alias(f"c{i}") for i in range(400)])
    assert C.drop_sparse_rows(wide, 99.9).count() == 5
    assert C.drop_sparse_rows(wide, 99).count() == 0
    assert P.missing_summary(wide).where("missing_count = 5").count() == 400
