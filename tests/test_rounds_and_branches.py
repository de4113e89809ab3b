import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidewash.functions.branches import run_branches
from tidewash.functions.rounds import RoundLog
from tidewash.operators import components, decisions, density, impute, missing, outliers, profile
from tidewash.plans import cleaning as plans


# --- Branches


def test_branches_run_at_the_same_time(spark):
    meet = threading.Barrier(2, timeout=60)

    def work(n):
        meet.wait()
        return spark.range(n).count()

    found = run_branches(spark, {"a": lambda: work(3), "b": lambda: work(5)})
    assert found == {"a": 3, "b": 5}
    assert run_branches(spark, {"one": lambda: 1}) == {"one": 1} and run_branches(spark, {}) == {}


def test_a_failing_branch_cancels_its_sibling(spark):
    started = threading.Event()
    seen = []

    def slow():
        started.set()
        rows = spark.range(0, 4, 1, 4).mapInPandas(wait, "id long")
        try:
            rows.count()
        except Exception as error:
            seen.append(error)
            raise
        # Jobs that come after the cancelled one do not run either.

    def wait(batches):
        time.sleep(120)
        yield from batches

    def bad():
        started.wait()
        time.sleep(2)
        raise KeyError("broken")

    began = time.time()
    with pytest.raises(KeyError, match="broken"):
        run_branches(spark, {"slow": slow, "bad": bad})
    assert time.time() - began < 60 and len(seen) == 1
    assert spark.range(7).count() == 7  # other jobs are not touched


# --- Rounds


class Stopped(RuntimeError):
    pass


class StopsAfter(RoundLog):
    """A log whose driver is lost after some rounds."""

    def __init__(self, spark, folder, rounds):
        super().__init__(spark, folder)
        self.rounds, self.done = rounds, []

    def finish(self, number, tables, state=None):
        super().finish(number, tables, state)
        self.done.append(number)
        if number == self.rounds:
            raise Stopped


def test_components_go_on_after_the_last_round(spark, tmp_path):
    links = [(i, i + 1) for i in range(40)] + [(1000, 1001), (1001, 1002)]
    edges = spark.createDataFrame(links, "id_a long, id_b long")
    expected = sorted(map(tuple, components.connected_components(edges).collect()))
    folder = str(tmp_path / "log")
    with pytest.raises(Stopped):
        components.connected_components(edges, log=StopsAfter(spark, folder, 2))
    again = StopsAfter(spark, folder, -1)
    # The edges are not needed any more: what the rounds have left is stored.
    nothing = spark.createDataFrame([], "id_a long, id_b long")
    found = components.connected_components(nothing, log=again)
    assert sorted(map(tuple, found.collect())) == expected
    assert min(again.done) == 3
    third = StopsAfter(spark, folder, -1)
    assert components.connected_components(nothing, log=third).count() == len(expected)
    assert third.done == []
    assert len([n for n in os.listdir(folder) if n.startswith("edges")]) == 1


def test_fills_go_on_after_the_last_round(spark, tmp_path):
    rows = [(i, float(i % 17), None if i % 5 == 0 else 2.0 * (i % 17) + i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    expected = sorted(map(tuple, impute.impute_iterative(df, "id", ["b"], ["a"], rounds=4).collect()))
    folder = str(tmp_path / "log")
    with pytest.raises(Stopped):
        impute.impute_iterative(df, "id", ["b"], ["a"], rounds=4, log=StopsAfter(spark, folder, 2))
    again = StopsAfter(spark, folder, -1)
    found = impute.impute_iterative(df, "id", ["b"], ["a"], rounds=4, log=again)
    assert sorted(map(tuple, found.collect())) == expected
    assert again.done == [3, 4]


def test_a_round_without_a_row_is_done_again(spark, tmp_path):
    log = RoundLog(spark, str(tmp_path / "log"))
    assert log.last() is None
    one = log.write(spark.range(3), "t", 0)
    log.finish(0, {"t": one}, {"x": [1.5]})
    log.write(spark.range(9), "t", 1)  # stopped before the row
    number, tables, state = log.last()
    assert (number, tables["t"].count(), state) == (0, 3, {"x": [1.5]})
    log.finish(1, {"t": log.write(spark.range(4), "t", 1)})
    assert log.last()[1]["t"].count() == 4


# --- Drivers, patterns, noise, sketches


def test_many_targets_are_counted_by_pattern(spark, monkeypatch):
    names = [f"c{i}" for i in range(7)]
    rows = [
        (i, *[None if (i * (k + 3)) % (k + 4) == 0 else float((i * (k + 1)) % 23) for k in range(7)])
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in names))
    whole = sorted(map(str, missing.missingness_profile(df, names).collect()))
    reads = []
    known = missing.value_frequencies
    monkeypatch.setattr(missing, "value_frequencies", lambda *a, **k: reads.append(1) or known(*a, **k))
    monkeypatch.setattr(missing, "chunks", lambda targets, fields: [targets[:2], targets[2:5], targets[5:]])
    monkeypatch.setattr(missing, "PATTERN_BITS", 3)
    assert sorted(map(str, missing.missingness_profile(df, names).collect())) == whole
    assert len(reads) == 1


def test_fills_fall_back_driver_by_driver(spark):
    rows = [
        (1, "x", 1, 10.0), (2, "x", 1, 20.0), (3, "x", 2, 60.0), (4, "y", 1, 5.0), (5, None, 1, 7.0),
        (6, "x", 1, None), (7, "x", 9, None), (8, "x", None, None), (9, "z", 1, None), (10, None, 1, None),
    ]
    df = spark.createDataFrame(rows, "id long, a string, b int, v double")
    found = {r["row_id"]: (float(r["value"]), r["reason"]) for r in
             impute.driver_fills(df, "v", "id", ["a", "b"]).collect()}
    assert found == {
        6: (15.0, "mean by a and b"), 7: (30.0, "mean by a"), 8: (30.0, "mean by a"),
        9: (20.4, "mean of the column"), 10: (20.4, "mean of the column"),
    }
    none = impute.driver_fills(df, "v", "id", [])
    assert {float(r["value"]) for r in none.collect()} == {20.4}
    assert impute.driver_fills(df.where("v is null"), "v", "id", ["a", "b"]).isEmpty()
    text = spark.createDataFrame(
        [(1, "x", "p"), (2, "x", "q"), (3, "x", "q"), (4, "y", "p"), (5, "y", None), (6, "w", None)],
        "id long, a string, v string",
    )
    modes = {r["row_id"]: r["value"] for r in impute.driver_fills(text, "v", "id", ["a"], "mode").collect()}
    assert modes == {5: "p", 6: "p"}
    with pytest.raises(ValueError):
        impute.driver_fills(df, "v", "id", ["a"], "median")


def test_fills_by_the_strongest_driver(spark):
    rows = [(i, i % 4, i % 3, None if i % 4 == 1 and i % 8 < 5 else float(10 * (i % 4))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, cause int, other int, v double")
    drivers = missing.missingness_drivers(missing.missingness_profile(df.drop("id"), ["v"]))
    assert impute.strongest_drivers(drivers, "v", 1) == ["cause"]
    done = plans.impute_table(df, "id", fills=plans.driven_fills("id", most=1, approved=True))
    assert done.data.where("v is null").isEmpty()
    assert {r["v"] for r in done.data.where("cause = 1").select("v").distinct().collect()} == {10.0}


def test_noise_can_be_removed(spark):
    values = [float(i % 50) for i in range(2000)] + [500.0, 500.5, 501.0, 501.2, 900.0, -700.0, None]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v double")
    records = density.with_density(outliers.outlier_records(df, "v", "id"), df, "v", eps=0.05)
    noise = {r["value"] for r in records.where("noise").collect()}
    assert noise == {900.0, -700.0} and records.count() == 6
    decided = decisions.approve(decisions.decide_by_rule(records, F.col("noise"), "noise"))
    left = decisions.apply_decisions(df, decided, "id")
    assert left.count() == len(values) - 2
    few = spark.createDataFrame([(i, float(i % 5)) for i in range(60)] + [(99, 80.0)], "id long, v double")
    one = density.with_density(outliers.outlier_records(few, "v", "id"), few, "v")
    assert [(r["value"], r["noise"]) for r in one.collect()] == [(80.0, False)]


def test_sketches_of_parts_add_up(spark):
    df = spark.range(50_000).selectExpr(
        "id % 5 AS part", "pow(rand(3), 3) * 1000 AS x", "if(id % 7 = 0, NULL, id % 1234) AS y",
        "concat('t', id % 300) AS s", "CAST(NULL AS DOUBLE) AS none",
    )
    names = ["x", "y", "s", "none"]
    one = {r["column"]: r for r in profile.sketch_report(profile.sketch_profile(df, names)).collect()}
    parts = profile.sketch_profile(df, names, by="part")
    assert parts.count() == 20
    merged = {r["column"]: r for r in profile.sketch_report(profile.merge_sketches(parts)).collect()}
    for found in (one, merged):
        assert {c: found[c]["n"] for c in names} == {"x": 50_000, "y": df.where("y is not null").count(), "s": 50_000, "none": 0}
        for c, exact in (("x", 50_000), ("y", 1234), ("s", 300)):
            assert abs(found[c]["num_unique"] - exact) <= profile.DISTINCT_ERROR * exact
        for c in ("x", "y"):
            for p in (25, 50, 75):
                at = found[c][f"q{p}"]
                below, upto, n = df.agg(
                    F.count_if(F.col(c) < at), F.count_if(F.col(c) <= at), F.count(c)
                ).first()
                assert below / n - profile.RANK_ERROR <= p / 100 <= upto / n + profile.RANK_ERROR
        assert found["s"]["q50"] is None and found["none"]["q50"] is None
    assert all(one[c]["num_unique"] == merged[c]["num_unique"] for c in names)
    assert all((one[c]["low"], one[c]["high"]) == (merged[c]["low"], merged[c]["high"]) for c in names)
