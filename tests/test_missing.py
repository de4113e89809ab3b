import random

import pytest

from tidewash.operators import missing as M


def brute_u(missing, present):
    return sum((a > b) + 0.5 * (a == b) for a in missing for b in present)


@pytest.mark.parametrize("slices", [None, 8])
def test_ranks_medians_and_direction(spark, slices):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        x = float(rng.randrange(40))
        t = None if rng.random() < (0.5 if x > 25 else 0.2) else 1.0
        rows.append((i, t, x if rng.random() < 0.9 else None))
    df = spark.createDataFrame(rows, "id int, t double, x double")
    got = {
        (r["target"], r["column"]): r
        for r in M.missingness_profile(df, ["t"], slices=slices).collect()
    }
    row = got[("t", "x")]
    gone = [x for _, t, x in rows if t is None and x is not None]
    here = [x for _, t, x in rows if t is not None and x is not None]
    assert row["statistic"] == brute_u(gone, here)
    ordered = sorted(gone)
    middle = (ordered[(len(gone) - 1) // 2] + ordered[len(gone) // 2]) / 2
    assert row["median_when_missing"] == middle
    assert row["direction"] == ("higher" if sum(gone) / len(gone) > sum(here) / len(here) else "lower")
    assert row["significant"] == (row["raw_p"] < 0.05)


def test_two_by_two_table_with_yates(spark):
    # 2 x 2 counts 10 20 / 30 40; with correction chi-squared = 0.4464...
    rows = []
    for flag, value, n in ((True, "a", 10), (True, "b", 20), (False, "a", 30), (False, "b", 40)):
        rows += [(None if flag else 1, value)] * n
    df = spark.createDataFrame(rows, "t int, v string")
    row = M.missingness_profile(df, ["t"]).where("column = 'v'").first()
    total, ad, bc = 100, 10 * 40, 20 * 30
    expected = total * (abs(ad - bc) - total / 2) ** 2 / (30 * 70 * 40 * 60)
    assert row["statistic"] == pytest.approx(expected)
    assert row["dof"] == 1
    assert row["p_value"] == 0.504


def test_one_value_or_one_side_means_no_signal(spark):
    df = spark.createDataFrame([(None, "a", None), (1, "a", "q"), (2, "a", "r")], "t int, v string, w string")
    rows = {r["column"]: r for r in M.missingness_profile(df, ["t"]).collect()}
    assert (rows["v"]["statistic"], rows["v"]["p_value"]) == (0.0, 1.0)
    assert (rows["w"]["dominant_val_missing"], rows["w"]["p_value"]) == (None, 1.0)


def test_all_null_columns_are_left_out(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "t int, v int")
    got = M.missingness_profile(df)
    assert {r["column"] for r in got.collect()} == {"v"}
    empty = df.where("false")
    assert M.missingness_profile(empty).isEmpty()
    assert M.null_rate_by_range(empty, "v").isEmpty()


def test_drivers_need_enough_signals(spark):
    rows = [(None if i % 2 else 1, "x" if i % 2 else "y") for i in range(200)]
    df = spark.createDataFrame(rows, "t int, v string")
    profile = M.missingness_profile(df)
    assert [r["column"] for r in M.missingness_drivers(profile).collect()] == ["v"]
    assert M.missingness_drivers(profile, min_signals=2).isEmpty()
