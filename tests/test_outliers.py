import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewash.operators import decisions as G
from tidewash.operators import density as D
from tidewash.operators import outliers as O


def numbers(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id int, x double")


def test_constant_column_has_no_outliers(spark):
    df = numbers(spark, [5.0] * 10)
    f = O.iqr_fences(df, ["x"])["x"]
    assert (f.lower, f.upper) == (5.0, 5.0)
    assert O.outlier_summary(df, ["x"]).first()["outlier_count"] == 0


def test_null_and_nan_are_never_outliers(spark):
    df = numbers(spark, [1.0, 2.0, 3.0, None, float("nan"), 1000.0, 2.0, 2.0, 3.0])
    assert [r["x"] for r in O.iqr_outlier_rows(df, "x").collect()] == [1000.0]
    left = O.remove_outliers(df, ["x"]).data
    assert left.count() == 8


def test_empty_and_all_null_columns(spark):
    df = numbers(spark, [None, None])
    assert O.outlier_summary(df, ["x"]).first()["outlier_count"] == 0
    assert O.boxplot_stats(df, ["x"]).isEmpty()
    assert O.iqr_outlier_rows(df, "x").isEmpty()
    assert O.outlier_records(df, "x", "id").isEmpty()
    assert D.numeric_outlier_report(df, ["x"]).isEmpty()
    assert O.remove_outliers(df.limit(0), ["x"]).data.isEmpty()


def test_capped_data_stays_inside_the_fences_used(spark):
    rng = random.Random(3)
    df = numbers(spark, [rng.gauss(0, 1) ** 3 for _ in range(500)] + [None])
    f = O.iqr_fences(df, ["x"])["x"]
    capped = O.winsorize(df, ["x"])
    low, high, nulls = capped.agg(F.min("x"), F.max("x"), F.count_if(F.col("x").isNull())).first()
    assert (low, high, nulls) == (f.lower, f.upper, 1)


def test_one_column_sequential_equals_single_pass(spark):
    rng = random.Random(4)
    df = numbers(spark, [rng.gauss(0, 1) ** 3 for _ in range(400)])
    a = O.remove_outliers(df, ["x"], sequential=True).data.collect()
    b = O.remove_outliers(df, ["x"], sequential=False).data.collect()
    assert sorted(a) == sorted(b)


def test_records_do_not_depend_on_the_partitioning(spark):
    rng = random.Random(5)
    rows = [(i, rng.gauss(0, 1) ** 5, rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    a = O.outlier_records(df, "x", "id").orderBy("index").collect()
    b = O.outlier_records(df.repartition(13), "x", "id").orderBy("index").collect()
    assert [r["row_id"] for r in a] == [r["row_id"] for r in b]
    assert [r["index"] for r in a] == list(range(1, len(a) + 1))
    assert a[0]["total"] == len(a)


def test_only_approved_removals_change_the_data(spark):
    df = numbers(spark, [1.0, 2.0, 3.0])
    table = spark.createDataFrame(
        [(0, "x", "remove", "r", True), (1, "x", "remove", "r", False), (2, "x", "keep", "r", True)],
        "row_id int, column string, action string, reason string, approved boolean",
    )
    assert [r["id"] for r in G.apply_decisions(df, table, "id").orderBy("id").collect()] == [1, 2]
    none = table.where("false")
    assert G.apply_decisions(df, none, "id").count() == 3


def brute_clusters(values, eps, min_samples):
    """Density clusters of numbers by their definition."""
    z = (np.array(values) - np.mean(values)) / (np.std(values) or 1.0)
    near = np.abs(z[:, None] - z[None, :]) <= eps
    core = near.sum(axis=1) >= min_samples
    cluster = [None] * len(z)
    number = -1
    last = None
    for i in sorted(np.flatnonzero(core), key=lambda i: z[i]):
        if last is None or z[i] - last > eps:
            number += 1
        cluster[i], last = number, z[i]
    for i in np.flatnonzero(~core):
        around = [(abs(z[j] - z[i]), z[j], cluster[j]) for j in np.flatnonzero(core & near[i])]
        if around:
            cluster[i] = min(around)[2]
    return cluster, core


@pytest.mark.parametrize("slices", [None, 9])
@pytest.mark.parametrize(("eps", "min_samples"), [(0.02, 3), (0.1, 5), (0.3, 2), (0.01, 1)])
def test_density_clusters_equal_the_definition(spark, eps, min_samples, slices):
    rng = random.Random(6)
    tails = [round(rng.expovariate(0.2) ** 1.5 + 50, 1) for _ in range(60)]
    tails += [round(-50 - rng.expovariate(0.3), 1) for _ in range(30)]
    values = [rng.uniform(-1, 1) for _ in range(600)] + tails
    rng.shuffle(values)
    df = numbers(spark, values)
    f = O.iqr_fences(df, ["x"])["x"]
    outliers = [v for v in values if v < f.lower or v > f.upper]
    clusters, core = brute_clusters(outliers, eps, min_samples)
    expected = {v: (c, bool(k)) for v, c, k in zip(outliers, clusters, core, strict=True)}
    got = D.outlier_clusters(df, ["x"], eps=eps, min_samples=min_samples, slices=slices).collect()
    assert {r["value"]: (r["cluster"], r["core"]) for r in got} == expected
    assert sum(r["n"] for r in got) == len(outliers)


def test_few_outliers_are_not_clustered(spark):
    df = numbers(spark, [1.0, 2.0, 3.0, 2.0, 2.0, 1.0, 3.0, 99.0, 98.0])
    assert D.outlier_clusters(df, ["x"]) is None
    row = D.numeric_outlier_report(df, ["x"]).first()
    assert row["n_outliers"] == 2 and row["n_clusters"] is None


def test_removal_filters_reach_the_scan(spark, tmp_path):
    rows = [(i, i % 9, float(i % 7)) for i in range(200)] + [(200, 10**6, 3.0), (201, 4, -1e9)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "id bigint, n bigint, x double").write.parquet(path)
    df = spark.read.parquet(path)
    left = O.remove_outliers(df, ["n", "x"])
    assert left.data.count() == 200
    plan = left.data._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    # A test for NaN has no form in the scan, so only whole numbers are pushed here.
    assert "LessThanOrEqual(n," in pushed and "GreaterThanOrEqual(n," in pushed
    found = O.iqr_outlier_rows(df, "n")
    assert [r["id"] for r in found.collect()] == [200]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(n," in plan[plan.index("PushedFilters") :]


def test_records_have_five_related_columns_beside_a_correlated_key(spark):
    rows = [(i, *(float((i * (k + 3)) % 17 + i) for k in range(6)), float(i % 5)) for i in range(90)]
    rows.append((90, *(1.0 for _ in range(6)), 1e6))
    df = spark.createDataFrame(
        rows, "id int, " + ", ".join(f"c{k} double" for k in range(6)) + ", x double"
    )
    records = O.outlier_records(df, "x", "id")
    assert len([c for c in records.columns if c.startswith("with_")]) == 5


def test_approved_caps_move_values_onto_the_fence(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(50)] + [(50, 99.0)], "id int, x double")
    records = O.outlier_records(df, "x", "id")
    held = G.decide_by_rule(records, F.lit(True), "all", action="cap")
    assert G.apply_decisions(df, held, "id", ["x"]).where("x = 99").count() == 1
    done = G.apply_decisions(df, G.approve(held), "id", ["x"])
    assert done.where("id = 50").first()["x"] == records.first()["upper"]
    assert done.count() == 51 and done.columns == df.columns
