import random

import pytest
from pyspark.sql import functions as F

from tidewash.functions.ordered import Ordered, with_position


def rows_of(count=200, groups=3, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        # One group holds two thirds of the rows.
        group = "hot" if rng.random() < 0.66 else f"g{rng.randrange(groups)}"
        rows.append((group, i, rng.randrange(9) if rng.random() < 0.4 else None))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("slices", [None, 1, 5, 60])
def test_running_sums_per_group(spark, slices):
    rows = rows_of()
    df = spark.createDataFrame(rows, "g string, k int, v int")
    got = (
        Ordered(df, ["k"], ["g"], slices=slices)
        .running_sums({"s": F.coalesce("v", F.lit(0)).cast("bigint"), "n": F.lit(1).cast("bigint")})
        .result()
        .collect()
    )
    total, number = {}, {}
    expected = {}
    for g, k, v in sorted(rows):
        total[g] = total.get(g, 0) + (v or 0)
        number[g] = number.get(g, 0) + 1
        expected[(g, k)] = (total[g], number[g])
    assert {(r["g"], r["k"]): (r["s"], r["n"]) for r in got} == expected


@pytest.mark.parametrize("slices", [None, 7, 60])
def test_nearest_values_on_both_sides(spark, slices):
    rows = rows_of(seed=2)
    df = spark.createDataFrame(rows, "g string, k int, v int")
    got = (
        Ordered(df, ["k"], ["g"], slices=slices)
        .nearest(F.col("v"), 3, before="b", after="a")
        .result()
        .collect()
    )
    in_order = {}
    for g, k, v in sorted(rows):
        in_order.setdefault(g, []).append((k, v))
    for r in got:
        seq = in_order[r["g"]]
        before = [v for k, v in seq if k < r["k"] and v is not None][::-1][:3]
        after = [v for k, v in seq if k > r["k"] and v is not None][:3]
        assert (r["b"], r["a"]) == (before, after)


def test_without_groups_and_position(spark):
    df = spark.range(0, 100).select((F.col("id") * 7 % 101).alias("k"))
    got = {r["k"]: r["row_id"] for r in with_position(df, ["k"], slices=6).collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))}


def test_driver_holds_slices_not_groups(spark):
    df = spark.range(0, 500).select(F.col("id").alias("g"), F.lit(1).alias("k"))
    ordered = Ordered(df, ["k"], ["g"], slices=10)
    assert len(ordered._cut) <= 10
