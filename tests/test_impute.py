import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewash.operators import impute as I
from tidewash.operators import nearest
from tidewash.operators.nearest import knn_features_fills


def series(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id int, v double")


def test_published_order_of_neighbours(spark):
    df = series(spark, [10.0, None, 20.0, None, None, 30.0, 40.0, 50.0])
    got = {
        r["row_id"]: [n["value"] for n in r["neighbours"]]
        for r in I.nearest_neighbours(df, "v", "id", slices=3).collect()
    }
    assert got[1] == [10.0, 20.0, 30.0, 40.0, 50.0]


@pytest.mark.parametrize("slices", [None, 12])
def test_neighbours_equal_the_outward_scan(spark, slices):
    rng = random.Random(8)
    values = [None if rng.random() < 0.3 or 60 <= i < 130 else float(i) for i in range(220)]
    expected = {}
    for i, v in enumerate(values):
        if v is None:
            found = sorted(
                (abs(j - i), j) for j, w in enumerate(values) if w is not None
            )[:5]
            expected[i] = [values[j] for _, j in found]
    rows = list(enumerate(values))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id int, v double").repartition(5)
    got = {
        r["row_id"]: [n["value"] for n in r["neighbours"]]
        for r in I.nearest_neighbours(df, "v", "id", slices=slices).collect()
    }
    assert got == expected


def test_nothing_present_gives_no_value(spark):
    df = series(spark, [None, None])
    assert [r["value"] for r in I.neighbour_fills(df, "v", "id").collect()] == [None, None]
    filled = I.apply_fills(df, I.neighbour_fills(df, "v", "id", approved=True), "v", "id")
    assert filled.where("v is null").count() == 2


@pytest.mark.parametrize("slices", [None, 10])
def test_knn_equals_sorting_all_rows(spark, slices):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        block = "hot" if rng.random() < 0.6 else "cold"
        rows.append((i, block, float(rng.randrange(50)), None if rng.random() < 0.3 else rng.random()))
    df = spark.createDataFrame(rows, "id int, b string, x double, v double")
    got = {
        r["row_id"]: float(r["value"])
        for r in I.knn_fills(df, "v", "x", "id", "b", k=4, slices=slices).collect()
    }
    for i, block, x, v in rows:
        if v is not None:
            continue
        order = sorted((r[2], r[0]) for r in rows if r[1] == block)
        place = {key: n for n, key in enumerate(order)}
        me = place[(x, i)]
        near = sorted(
            (abs(r[2] - x), abs(place[(r[2], r[0])] - me), place[(r[2], r[0])], r[3])
            for r in rows
            if r[1] == block and r[3] is not None
        )[:4]
        assert got[i] == pytest.approx(sum(n[3] for n in near) / 4)


@pytest.mark.parametrize("how", ["mean", "median", "mode"])
def test_group_values(spark, how):
    rng = random.Random(10)
    rows = [("hot" if rng.random() < 0.7 else "g", float(rng.randrange(6))) for _ in range(200)]
    df = spark.createDataFrame([*rows, ("hot", None), (None, 1.0)], "g string, v double")
    got = {r["group"]: r["value"] for r in I.group_values(df, "v", "g", how, slices=6).collect()}
    for g in ("hot", "g"):
        values = [v for k, v in rows if k == g]
        if how == "mode":
            most = max(values.count(v) for v in values)
            expected = min(v for v in values if values.count(v) == most)
        else:
            expected = getattr(statistics, how)(values)
        assert got[g] == pytest.approx(expected)


def test_statistical_choice_follows_the_skew(spark):
    values = [1.0, 2.0, 3.0, 100.0, None]
    rows = [(v, float(i) if i else None, "a" if i < 3 else None) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "skewed double, even double, s string")
    ways = {c: (way, value) for c, way, value in I.statistical_choices(df)}
    assert ways["skewed"] == ("median", 2.5)
    assert ways["even"] == ("mean", 2.5)
    assert ways["s"] == ("mode", "a")
    assert I.impute_statistical(df).dropna().count() == 5


def test_fills_that_are_no_numbers_are_skipped(spark):
    df = series(spark, [None, None, 3.0])
    fills = spark.createDataFrame(
        [(0, "v", "x", "r", True), (1, "v", "7", "r", True), (2, "v", "9", "r", True)],
        "row_id int, column string, value string, reason string, approved boolean",
    )
    got = {r["id"]: r["v"] for r in I.apply_fills(df, fills, "v", "id").collect()}
    assert got == {0: None, 1: 7.0, 2: 3.0}


def test_iterative_fill_recovers_a_linear_law(spark):
    rng = random.Random(11)
    rows = []
    for i in range(200):
        a, b = rng.random(), rng.random()
        y = 2 * a - 3 * b + 1
        rows.append((i, None if i % 7 == 0 else y, a, b))
    df = spark.createDataFrame(rows, "id int, y double, a double, b double")
    filled = I.impute_iterative(df, "id", ["y"], ["a", "b"], rounds=2)
    for r in filled.collect():
        assert r["y"] == pytest.approx(2 * r["a"] - 3 * r["b"] + 1, abs=1e-9)


def test_constant_predictor_does_no_harm(spark):
    rows = [(i, None if i == 3 else float(i), 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, y double, c double")
    filled = I.impute_iterative(df, "id", ["y"], ["c"], rounds=1)
    assert np.isfinite(filled.where(F.col("id") == 3).first()["y"])


def test_later_columns_see_earlier_fills(spark):
    df = spark.createDataFrame([(0, None, None), (1, 4.0, None), (2, 6.0, 1.0)], "id int, a double, b double")
    seen = []

    def fills(table, name):
        seen.append((name, table.where("a is null").count()))
        return I.neighbour_fills(table, name, "id", approved=True)

    done = I.impute_sequential(df, "id", fills)
    assert seen == [("a", 1), ("b", 0)]
    assert done.where("a is null or b is null").isEmpty()


@pytest.mark.parametrize("tile", [2048, 25])
@pytest.mark.parametrize("hot", [0.0, 0.5])
def test_knn_by_several_features(spark, tile, hot):
    rng = random.Random(14)
    rows = []
    for i in range(260):
        # A share of the rows crowds into one corner, with equal distances.
        corner = rng.random() < hot
        a = float(rng.randrange(3)) if corner else rng.uniform(0, 60)
        b = float(rng.randrange(3)) if corner else rng.uniform(0, 60)
        rows.append((i, a, b if i % 50 else None, rng.random() if rng.random() < 0.7 else None))
    df = spark.createDataFrame(rows, "id int, a double, b double, v double")
    got = {
        r["row_id"]: float(r["value"])
        for r in knn_features_fills(df, "v", ["a", "b"], "id", k=4, tile=tile).collect()
    }
    a_all = np.array([r[1] for r in rows])
    b_all = np.array([r[2] for r in rows if r[2] is not None])
    expected = {}
    for i, a, b, v in rows:
        if v is not None or b is None:
            continue
        near = sorted(
            (
                round(((a - x) / a_all.std()) ** 2 + ((b - y) / b_all.std()) ** 2, 9),
                j,
                w,
            )
            for j, x, y, w in rows
            if w is not None and y is not None
        )[:4]
        expected[i] = sum(n[2] for n in near) / 4
    assert got.keys() == expected.keys()
    assert all(got[i] == pytest.approx(expected[i]) for i in got)


@pytest.mark.parametrize("tile", [10, 2048])
def test_knn_within_blocks(spark, tile):
    rng = random.Random(15)
    rows = [
        (i, rng.choice([None, "a/b", "c"]), float(rng.randrange(40)), rng.uniform(0, 9),
         rng.random() if rng.random() < 0.6 else None)
        for i in range(220)
    ]
    # One block with two donors only, one with none.
    rows += [(900, "few", 1.0, 1.0, 0.5), (901, "few", 2.0, 2.0, 1.5), (902, "few", 3.0, 3.0, None)]
    rows += [(903, "none", 3.0, 3.0, None)]
    df = spark.createDataFrame(rows, "id int, part string, a double, b double, v double")
    found = knn_features_fills(df, "v", ["a", "b"], "id", k=3, tile=tile, block="part")
    got = {r["row_id"]: float(r["value"]) for r in found.collect()}
    sa, sb = np.std([r[2] for r in rows]), np.std([r[3] for r in rows])
    expected = {}
    for i, part, a, b, v in rows:
        near = sorted(
            (round(((a - x) / sa) ** 2 + ((b - y) / sb) ** 2, 9), j, w)
            for j, own, x, y, w in rows
            if w is not None and own == part
        )[:3]
        if v is None and near:
            expected[i] = sum(n[2] for n in near) / len(near)
    assert got == pytest.approx(expected)


def test_cells_are_even_and_a_table(spark):
    rows = spark.range(6000).selectExpr(
        "id", "array(rand(1), pow(rand(2), 4), double(0)) AS x", "0.0D AS value", "'' AS cell"
    )
    sizes = nearest._in_cells(rows, 3, 100).groupBy("cell").count().collect()
    assert sum(r["count"] for r in sizes) == 6000
    assert max(r["count"] for r in sizes) <= 100 and len(sizes) < 8 * 6000 / 100 * 2
    same = nearest._in_cells(rows.selectExpr("id", "array(1D, 2D) AS x", "value", "cell"), 2, 100)
    assert same.select("cell").distinct().count() == 1
    ties = rows.selectExpr(
        "id", "array(if(id % 20 = 0, id / 20, 300D), double(id % 2)) AS x", "value", "cell"
    )
    assert nearest._in_cells(ties, 2, 100).select("cell").distinct().count() > 2


def test_knn_without_donors(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 2.0, None)], "id int, a double, v double")
    assert knn_features_fills(df, "v", ["a"], "id").isEmpty()


def test_unknown_strategy_is_refused(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "id int, x double")
    with pytest.raises(ValueError):
        I.impute_statistical(df, strategy="meen")


def test_driver_means_do_not_depend_on_the_order_of_addition(spark):
    draw = random.Random(4)
    rows = [(draw.randrange(40), draw.randrange(100_000, 400_000) / 1000) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a int, v double")
    expected = {None: math.fsum(v for _, v in rows) / len(rows)}
    for a in range(40):
        own = [v for other, v in rows if other == a]
        expected[a] = math.fsum(own) / len(own)
    for parts in (1, 3, 7):
        found = I.driver_values(df.repartition(parts), "v", ["a"]).collect()
        assert {r["_d0"]: r["value"] for r in found} == expected
    large = spark.createDataFrame([(1, 1e300), (1, 3e300), (2, math.inf)], "a int, v double")
    found = I.driver_values(large, "v", ["a"]).collect()
    assert {r["_d0"]: r["value"] for r in found} == {1: 2e300, 2: math.inf, None: math.inf}
