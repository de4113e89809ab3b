import random

import numpy as np
import pytest

from tidewash.functions.quantiles import exact_quantiles

PROBS = (0.0, 0.05, 0.25, 0.5, 0.75, 0.99, 1.0)


def shapes():
    rng = random.Random(5)
    return {
        "spread": [rng.gauss(0, 1) for _ in range(5000)],
        "one value fills a third": [
            7.0 if rng.random() < 0.4 else rng.uniform(0, 100) for _ in range(5000)
        ],
        "few values": [float(rng.randrange(3)) for _ in range(5000)],
        "constant": [2.5] * 3000,
        "two": [1.0, 2.0],
        "one": [4.0],
    }


@pytest.mark.parametrize("limit", [1, 40, 100_000])
@pytest.mark.parametrize("name", list(shapes()))
def test_equal_to_numpy(spark, name, limit):
    values = shapes()[name]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = exact_quantiles(df, ["x"], PROBS, sort_limit=limit)["x"]
    assert got.count == len(values)
    assert np.allclose([got[p] for p in PROBS], np.quantile(values, PROBS), rtol=1e-12, atol=0)


def test_nulls_and_nan_are_left_out(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (1.0,), (3.0,)], "x double")
    got = exact_quantiles(df, ["x"], (0.5,))["x"]
    assert (got.count, got[0.5]) == (2, 2.0)


def test_empty(spark):
    df = spark.createDataFrame([], "x double")
    got = exact_quantiles(df, ["x"], (0.5,))["x"]
    assert (got.count, got[0.5]) == (0, None)
