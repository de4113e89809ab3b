import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewash.functions.rounds import RoundLog
from tidewash.operators import components as K
from tidewash.operators import merge as G
from tidewash.operators import similar as S


def vectors(count, seed, dims=6, hot=0.0):
    """Random vectors; a share ``hot`` of them lies close to one direction."""
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(count, dims))
    near = rng.random(count) < hot
    rows[near] = np.ones(dims) + 0.2 * rng.normal(size=(near.sum(), dims))
    rows[0] = 0.0
    return rows


def table(spark, rows, text_ids=False):
    data = [(f"v{i:04d}" if text_ids else i, [float(x) for x in r]) for i, r in enumerate(rows)]
    kind = "string" if text_ids else "bigint"
    return spark.createDataFrame(data, f"id {kind}, vector array<double>")


def brute_pairs(rows, threshold):
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    unit = np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)
    cosines = unit @ unit.T
    return {
        (i, j): cosines[i, j]
        for i in range(len(rows))
        for j in range(i + 1, len(rows))
        if cosines[i, j] >= threshold
    }


@pytest.mark.parametrize(("tile", "hot"), [(2048, 0.0), (20, 0.0), (20, 0.4), (7, 0.4)])
def test_pairs_equal_the_full_matrix(spark, tile, hot):
    rows = vectors(150, 1, hot=hot)
    expected = brute_pairs(rows, 0.8)
    got = S.cosine_pairs(table(spark, rows), 0.8, tile=tile).collect()
    assert len(got) == len(expected)
    found = {(r["id_a"], r["id_b"]): r["cosine"] for r in got}
    assert found.keys() == expected.keys()
    assert all(found[p] == pytest.approx(expected[p]) for p in found)


def test_text_ids(spark):
    rows = vectors(60, 2, hot=0.3)
    got = S.cosine_pairs(table(spark, rows, text_ids=True), 0.9, tile=15).collect()
    expected = {(f"v{i:04d}", f"v{j:04d}") for i, j in brute_pairs(rows, 0.9)}
    assert {(r["id_a"], r["id_b"]) for r in got} == expected


def groups_of(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("tile", [2048, 16])
def test_spanning_pairs_connect_the_same_vectors(spark, tile):
    rows = vectors(160, 3, hot=0.5)
    full = brute_pairs(rows, 0.85)
    few = [
        (r["id_a"], r["id_b"])
        for r in S.cosine_pairs(table(spark, rows), 0.85, spanning=True, tile=tile).collect()
    ]
    assert set(few) <= set(full)
    assert len(few) < len(full) / 2
    assert groups_of(few) == groups_of(full)


def test_spanning_pairs_compare_no_two_vectors_of_the_large_component(spark, monkeypatch):
    rows = vectors(400, 9, dims=4, hot=0.6)
    full = brute_pairs(rows, 0.6)
    products, real = [], S.meet

    def meet(homes, visits, *rest, **named):
        if named.get("in_parts"):
            sizes = [side.groupBy("target").count().toPandas() for side in (homes, visits)]
            both = sizes[0].merge(sizes[1], on="target")
            products.append(int((both["count_x"] * both["count_y"]).sum()))
        return real(homes, visits, *rest, **named)

    monkeypatch.setattr(S, "meet", meet)
    few = [
        (r["id_a"], r["id_b"])
        for r in S.cosine_pairs(table(spark, rows), 0.6, spanning=True, tile=20).collect()
    ]
    assert sum(products) < 400 * 399 / 2 / 3  # every pair would be 400 * 399 / 2
    assert set(few) <= set(full) and len(set(few)) == len(few) < len(full) / 2
    assert groups_of(few) == groups_of(full)


@pytest.mark.parametrize("spanning", [False, True])
def test_blocks_are_cut_again_and_again(spark, monkeypatch, spanning):
    monkeypatch.setattr(S, "FAN", 3)
    rows = vectors(170, 5, dims=4, hot=0.3)
    rows[100:130] = rows[99]  # copies, which nothing cuts apart
    df = table(spark, rows)
    stored, levels = S._in_blocks(df, 12, "bigint")
    assert len(levels) > 2
    sizes = {r["block"]: r["count"] for r in stored.groupBy("block").count().collect()}
    assert sum(sizes.values()) == 170 and sum(n > 12 for n in sizes.values()) <= 1
    # No block lies within another one, and no level gives a block more pivots than FAN.
    assert not any(a != b and b.startswith(a) for a in sizes for b in sizes)
    for level in levels:
        assert max(r["count"] for r in level.groupBy("target").count().collect()) <= 3
    expected = brute_pairs(rows, 0.9)
    got = S.cosine_pairs(df, 0.9, spanning=spanning, tile=12).collect()
    found = [(r["id_a"], r["id_b"]) for r in got]
    if spanning:
        assert set(found) <= set(expected)
        assert groups_of(found) == groups_of(expected)
    else:
        assert sorted(found) == sorted(expected)


def test_moments_and_zscore_cutoff(spark):
    rows = vectors(80, 4)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    unit = np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)
    matrix = unit @ unit.T
    df = table(spark, rows).repartition(5)
    n, mean, deviation = S.similarity_moments(df)
    assert n == 80
    assert (mean, deviation) == pytest.approx((matrix.mean(), matrix.std()))
    strict = {(r["id_a"], r["id_b"]) for r in S.zscore_pairs(df, 1.5).collect()}
    i, j = np.nonzero(np.triu(matrix > matrix.mean() + 1.5 * matrix.std(), 1))
    assert strict == set(zip(i.tolist(), j.tolist(), strict=True))


def test_threshold_must_be_positive_and_empty_input_works(spark):
    df = table(spark, vectors(3, 5))
    with pytest.raises(ValueError):
        S.cosine_pairs(df, 0.0)
    assert S.cosine_pairs(df.where("false"), 0.5).isEmpty()
    assert S.similarity_moments(df.where("false")) == (0, 0.0, 0.0)


@pytest.mark.parametrize("shape", ["random", "chain", "star", "loops"])
def test_components(spark, shape):
    rng = random.Random(12)
    edges = {
        "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(120)],
        "chain": [(i, i + 1) for i in range(300) if i % 100 != 99],
        "star": [(0, i) for i in range(1, 200)] + [(500, 501)],
        "loops": [(1, 1), (2, 3), (3, 2)],
    }[shape]
    df = spark.createDataFrame(edges, "id_a bigint, id_b bigint")
    got = {r["node"]: r["component"] for r in K.connected_components(df).collect()}
    assert got == groups_of([(a, b) for a, b in edges if a != b])


@pytest.mark.parametrize("last_edges", [0, 7, 60, 10**9])
def test_components_finished_in_one_task(spark, tmp_path, last_edges):
    rng = random.Random(17)
    pairs = [(f"n{rng.randrange(200)}", f"n{rng.randrange(200)}") for _ in range(110)]
    pairs += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    edges = spark.createDataFrame(pairs, "id_a string, id_b string")
    expected = groups_of([p for p in pairs if p[0] != p[1]])
    for log in (None, RoundLog(spark, str(tmp_path / "rounds"))):
        got = K.connected_components(edges, log=log, last_edges=last_edges).collect()
        assert {r["node"]: r["component"] for r in got} == expected
    # With its log it goes on from the last finished round, to the same end.
    again = K.connected_components(edges, log=log, last_edges=last_edges).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_no_edges(spark):
    df = spark.createDataFrame([], "id_a string, id_b string")
    assert K.connected_components(df).isEmpty()


def test_cluster_size_limits(spark):
    edges = [(0, i) for i in range(1, 5)] + [(10, 11)]
    df = spark.createDataFrame(edges, "id_a bigint, id_b bigint")
    kept = K.clusters_within(K.connected_components(df), 2, 4).collect()
    assert {r["member"] for r in kept} == {10, 11}


def edit_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


@pytest.mark.parametrize("distance", [1, 2])
def test_edit_candidates_equal_all_comparisons(spark, distance):
    rng = random.Random(13)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(90)})
    df = spark.createDataFrame([(w,) for w in words], "value string")
    got = {(r["value_a"], r["value_b"]): r["distance"] for r in G.edit_candidates(df, distance).collect()}
    expected = {
        (a, b): edit_distance(a, b)
        for a in words
        for b in words
        if a < b and edit_distance(a, b) <= distance
    }
    assert got == expected


def column_of(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string")


def test_canonical_examples(spark):
    df = column_of(spark, ["english|welsh", "welsh, english", "welsh", "french", "usa, canada", "canada"])
    got = {r["original"]: r["merged_to"] for r in G.canonical_merge_map(df, "v").collect()}
    assert got == {"english|welsh": "english, welsh", "welsh, english": "english, welsh"}


def test_clusters_with_digits_are_skipped_and_shortest_wins(spark):
    clusters = spark.createDataFrame(
        [("a", "abcd", 3), ("a", "abc", 3), ("a", "abd", 3), ("t", "type 1", 2), ("t", "type", 2)],
        "cluster_id string, member string, size bigint",
    )
    got = {r["original"]: r["merged_to"] for r in G.shortest_merge_map(clusters, "v").collect()}
    assert got == {"abcd": "abc", "abc": "abc", "abd": "abc"}


def test_merge_targets_are_fixed_points(spark):
    df = column_of(spark, ["color"] * 5 + ["colour"] * 2 + ["colours", "tree", "Trea"])
    merge_map = G.edit_merge_map(df, "v")
    targets = {r["original"]: r["merged_to"] for r in merge_map.collect()}
    assert targets["colours"] == "color"
    assert all(targets.get(t, t) == t for t in targets.values())
    untouched = G.apply_merge_map(df, merge_map, ["v"])
    assert sorted(map(tuple, untouched.collect())) == sorted(map(tuple, df.collect()))
    approved = merge_map.withColumn("approved", F.lit(True))
    once = G.apply_merge_map(df, approved, ["v"])
    twice = G.apply_merge_map(once, approved, ["v"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert once.select("v").distinct().count() == 2


def test_synonyms(spark):
    df = column_of(spark, ["USA ", "canada", None])
    synonyms = spark.createDataFrame([("usa", "united states")], "synonym string, preferred string")
    row = G.synonym_merge_map(df, "v", synonyms).first()
    assert (row["original"], row["merged_to"], row["approved"]) == ("usa", "united states", False)
    approved = G.synonym_merge_map(df, "v", synonyms).withColumn("approved", F.lit(True))
    got = [r["v"] for r in G.apply_merge_map(df, approved, ["v"]).orderBy("id").collect()]
    assert got == ["united states", "canada", None]


def trigrams(value):
    padded = f" {value} "
    found = {}
    for i in range(len(padded) - 2):
        found[padded[i : i + 3]] = found.get(padded[i : i + 3], 0) + 1
    return found


@pytest.mark.parametrize("threshold", [0.2013, 0.5017, 0.6209, 0.9001])
def test_sparse_pairs_equal_the_full_matrix(spark, threshold):
    rng = random.Random(21)
    words = ["lamp", "lamps", "big lamp", "lampshade", "chair", "chairs", "red chair", "x", "日本語"]
    values = {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(80)}
    df = spark.createDataFrame([(f" {v.upper()} ",) for v in values] + [(None,), (" ",)], "v string")
    terms = S.trigram_terms(df, "v")
    expected = {}
    counts = {v: trigrams(v) for v in values}
    for a in values:
        for b in values:
            dot = sum(n * counts[b].get(t, 0) for t, n in counts[a].items())
            norm = (sum(n * n for n in counts[a].values()) * sum(n * n for n in counts[b].values())) ** 0.5
            if a < b and dot / norm >= threshold + 1e-9:
                expected[a, b] = dot / norm
    got = S.sparse_cosine_pairs(terms, threshold).collect()
    assert len(got) == len(expected)
    for r in got:
        assert r["cosine"] == pytest.approx(expected[r["id_a"], r["id_b"]])
    n, mean, deviation = S.sparse_similarity_moments(terms)
    every = sorted(values)
    matrix = np.array(
        [
            [
                sum(x * counts[b].get(t, 0) for t, x in counts[a].items())
                / (sum(x * x for x in counts[a].values()) * sum(x * x for x in counts[b].values())) ** 0.5
                for b in every
            ]
            for a in every
        ]
    )
    assert (n, mean, deviation) == (len(every), pytest.approx(matrix.mean()), pytest.approx(matrix.std()))


def test_sparse_candidates_are_far_below_all_pairs(spark):
    rng = random.Random(22)
    values = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(600)]
    values += [v + "s" for v in values[:100]]
    terms = S.trigram_terms(spark.createDataFrame([(v,) for v in values], "v string"), "v")
    found = S.sparse_cosine_pairs(terms, 0.75)
    assert found.count() == 100
    # What the join on rare trigrams makes, before any comparison.
    vectors = S._unit_terms(terms).select("id", "terms")
    joined = vectors.select("id", F.explode("terms").alias("t"))
    upper = joined.groupBy("t").count().agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0]
    assert upper < len(values) ** 2 / 20


def test_pairs_within_blocks(spark):
    rows = vectors(60, 6, hot=0.5)
    df = table(spark, rows).withColumn("b", F.when(F.col("id") % 3 != 0, F.col("id") % 3))
    got = {(r["id_a"], r["id_b"]) for r in S.cosine_pairs(df, 0.8, block="b").collect()}
    assert got == {(i, j) for i, j in brute_pairs(rows, 0.8) if i % 3 == j % 3}


def test_edit_candidates_of_long_texts(spark):
    rng = random.Random(14)
    base = "".join(rng.choice("abcd ") for _ in range(10_000)).strip()
    edited = base[:5000] + "x" + base[5001:9000] + base[9001:]
    other = "".join(rng.choice("abcd ") for _ in range(10_000)).strip()
    df = spark.createDataFrame([(base,), (edited,), (other,)], "value string")
    found = G.edit_candidates(df, 2).collect()
    assert [r["distance"] for r in found] == [2]
