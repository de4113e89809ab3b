"""How queries deal out their rows where Spark takes every table for a large one."""

import re

import numpy as np
import pytest

import __spark_entry__ as entry
from tidewash.operators import nearest as N, similar as S

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def no_small_tables(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sketch_profile_deals_no_rows_out_by_column(spark, no_small_tables):
    found = entry.queries()["sketch_profile"](spark, FOLDER)
    assert not re.search(r"SortMergeJoin \[column", plan_of(found))
    assert [r["quantiles_ok"] and r["distinct_ok"] for r in found.collect()] == [True] * 3


def test_tiles_of_a_listing_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE", 8)
    monkeypatch.setattr(S, "LISTING_TILES", 4)
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 8)))]
    tiles = []
    real = S.meet
    monkeypatch.setattr(S, "meet", lambda *a, **k: tiles.append(a[4]) or real(*a, **k))
    table = spark.createDataFrame(rows, "id bigint, vector array<double>")
    found = {(r["id_a"], r["id_b"]) for r in S.cosine_pairs(table, 0.5).collect()}
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    assert found == {(a, b) for a, b in np.argwhere(unit @ unit.T >= 0.5).tolist() if a < b}
    assert tiles[-1] == 50


def test_a_tile_gives_its_pairs_in_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "PAIRS_AT_ONCE", 7)
    monkeypatch.setattr(S, "MOST_PRODUCTS", 100)
    rows = [(i, [1.0, i / 1000]) for i in range(30)]
    table = spark.createDataFrame(rows, "id bigint, vector array<double>")
    sizes = []
    real = S.meet

    def meet(homes, visits, compare, *rest, **named):
        home, visit = homes.toPandas(), visits.toPandas()
        sizes.extend(len(part) for part in compare(visit, home))
        return real(homes, visits, compare, *rest, **named)

    monkeypatch.setattr(S, "meet", meet)
    assert S.cosine_pairs(table, 0.5).count() == 30 * 29 // 2
    assert sum(sizes) == 30 * 29 // 2 and max(sizes) <= 7


def test_a_spanning_tile_holds_no_whole_matrix(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_PRODUCTS", 100)
    shapes = []
    real_forest, real_meet = S.forest, S.meet

    def meet(homes, visits, compare, *rest, **named):
        home, visit = homes.toPandas(), visits.toPandas()
        monkeypatch.setattr(S, "forest", lambda m: shapes.append(m.size) or real_forest(m))
        list(compare(visit, home))
        monkeypatch.setattr(S, "forest", real_forest)
        return real_meet(homes, visits, compare, *rest, **named)

    monkeypatch.setattr(S, "meet", meet)
    table = spark.createDataFrame(
        [(i, [1.0, i / 1000]) for i in range(30)], "id bigint, vector array<double>"
    )
    found = [(r["id_a"], r["id_b"]) for r in S.cosine_pairs(table, 0.5, spanning=True).collect()]
    assert max(shapes) <= 100 and len(found) < 60
    assert {x for pair in found for x in pair} == set(range(30))


def test_rows_go_down_the_cells_unsorted_and_once(spark, monkeypatch):
    plans = {}
    real = N.write_scratch

    def stored(df, label="table", **named):
        plans[label] = plan_of(df)
        return real(df, label, **named)

    monkeypatch.setattr(N, "write_scratch", stored)
    rng = np.random.default_rng(2)
    rows = [(i, *map(float, rng.normal(size=2)), None if i % 5 == 0 else float(i)) for i in range(600)]
    table = spark.createDataFrame(rows, "id bigint, a double, b double, v double")
    found = N.knn_features_fills(table, "v", ["a", "b"], "id", k=3, tile=8)
    assert not re.search("Sort|hashpartitioning|Union", plans["homes"])
    assert not re.search("SortAggregate|Union", plans["visits"])

    x = np.array([r[1:3] for r in rows])
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    donors = [i for i in range(600) if i % 5]
    got = {r["row_id"]: float(r["value"]) for r in found.collect()}
    assert sorted(got) == list(range(0, 600, 5))
    for i, value in got.items():
        far = ((x[donors] - x[i]) ** 2).sum(axis=1)
        assert value == pytest.approx(np.mean([donors[j] for j in np.argsort(far)[:3]]))
