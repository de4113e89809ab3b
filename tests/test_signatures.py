import numpy as np
import pandas as pd
import pytest

from tidewash.operators import merge, similar, signatures
from tidewash.operators.merge import similarity_clusters
from tidewash.operators.vectors import unit_rows


def near_groups(spark, seed=3, groups=60, alone=600, dims=48):
    pick = np.random.default_rng(seed)
    rows = [*pick.normal(size=(alone, dims))]
    for g in range(groups):
        center = pick.normal(size=dims)
        rows += [center + (0.2 + 0.01 * g) * pick.normal(size=dims) for _ in range(5)]
    rows += [rows[0]] * 30 + [np.zeros(dims)]
    table = [(i, [float(x) for x in row], None if i % 7 == 0 else i % 3) for i, row in enumerate(rows)]
    return spark.createDataFrame(table, "id long, vector array<double>, part int").repartition(4), rows


def all_pairs(rows, least):
    unit = unit_rows(pd.Series(rows))
    i, j = np.nonzero(np.triu(unit @ unit.T >= least, 1))
    return set(zip(i.tolist(), j.tolist()))


@pytest.mark.parametrize("threshold", [0.75, 0.9])
def test_recall_against_the_full_matrix(spark, threshold):
    table, rows = near_groups(spark)
    expected = all_pairs(rows, threshold)
    found = similar.cosine_pairs(table, threshold, recall=0.95).collect()
    pairs = [(r.id_a, r.id_b) for r in found]
    assert len(set(pairs)) == len(pairs)  # a pair comes from one table only
    assert set(pairs) <= expected
    assert len(pairs) >= 0.9 * len(expected)
    few = signatures.Signatures(tables=1, bits=24)
    assert signatures.signature_pairs(table, threshold, signatures=few).count() < 0.9 * len(expected)


def test_tiles_and_blocks_of_signatures(spark):
    table, rows = near_groups(spark)
    both = [
        {(r.id_a, r.id_b) for r in signatures.signature_pairs(table, 0.8, tile=tile).collect()}
        for tile in (100, 4096)
    ]
    assert both[0] == both[1] and both[0]
    expected = {
        (a, b) for a, b in all_pairs(rows, 0.8)
        if (None if a % 7 == 0 else a % 3) == (None if b % 7 == 0 else b % 3)
    }
    for tile in (100, 4096):
        within = similar.cosine_pairs(table, 0.8, block="part", tile=tile).collect()
        assert {(r.id_a, r.id_b) for r in within} == expected
    some = similar.cosine_pairs(table, 0.8, block="part", recall=0.99).collect()
    assert {(r.id_a, r.id_b) for r in some} <= expected and len(some) > 0.9 * len(expected)


def test_clusters_by_signatures(spark):
    table, _ = near_groups(spark)
    exact = {(r.cluster_id, r.member) for r in similarity_clusters(table, 0.8, largest=100).collect()}
    found = {
        (r.cluster_id, r.member)
        for r in similarity_clusters(table, 0.8, largest=100, recall=0.999).collect()
    }
    assert len(exact & found) >= 0.95 * len(exact)


def test_signatures_of_nothing_and_bad_arguments(spark):
    none = spark.createDataFrame([], "id long, vector array<double>")
    assert similar.cosine_pairs(none, 0.9, recall=0.9).isEmpty()
    empty = spark.createDataFrame([(1, None), (2, [1.0])], "id long, vector array<double>")
    assert similar.cosine_pairs(empty, 0.9, recall=0.9).isEmpty()
    with pytest.raises(ValueError):
        similar.cosine_pairs(none, 0.9, recall=1.0)
    with pytest.raises(ValueError):
        similar.cosine_pairs(none, 0.0, recall=0.9)
    more = signatures.Signatures.for_recall(0.8, 0.95, 10**9)
    less = signatures.Signatures.for_recall(0.8, 0.95, 10**4)
    assert more.bits > less.bits and more.tables > less.tables


def test_products_with_many_pivots_are_made_in_strips():
    batch = pd.DataFrame({"id": range(10_000)})
    parts = list(similar._strips(batch, 50_000))
    assert max(len(p) for p in parts) * 50_000 <= similar.MOST_PRODUCTS
    assert sum(map(len, parts)) == 10_000 and len(list(similar._strips(batch, 10**9))) == 10_000


# --- Edits between values that share most of their text


def close_pairs(values, distance):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    ordered = sorted(set(values))
    return {
        (a, b, edits(a, b))
        for i, a in enumerate(ordered)
        for b in ordered[i + 1 :]
        if abs(len(a) - len(b)) <= distance and edits(a, b) <= distance
    }


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_crowded_pieces_lose_no_pair(spark, monkeypatch, distance):
    pick = np.random.default_rng(distance)
    values = [f"name{k:04d}" for k in pick.choice(2000, 90, replace=False)]
    values += [f"name{k}" for k in range(40)] + ["", "n", "na", "aaaa", "aaab", "aaa", "aa\0aa"]
    values += ["".join(pick.choice(list("ab"), int(pick.integers(1, 7)))) for _ in range(60)]
    table = spark.createDataFrame([(v,) for v in values], "value string")
    expected = close_pairs([v.strip() for v in values if v.strip()], distance)
    for crowd in (merge.CROWD, 0):  # with 0 all pieces are crowded
        monkeypatch.setattr(merge, "CROWD", crowd)
        found = {tuple(r) for r in merge.edit_candidates(table, distance).collect()}
        assert found == expected


def test_numbered_names_are_not_all_paired(spark):
    count = 100_000
    names = spark.range(count).selectExpr("concat('customer#', lpad(id, 9, '0')) AS value")
    candidates = merge.edit_pairs(names, 1)
    assert candidates.count() < count * count / 2 * 0.003
    # Numbers that differ in one of five digits.
    assert merge.edit_candidates(names, 1).count() == count * 45 // 2


def test_similar_long_values(spark):
    pick = np.random.default_rng(9)
    text = "".join(pick.choice(list("abcdefghijklmnop"), 10_000))
    other = "".join(pick.choice(list("qrstuvwxyz"), 10_000))
    values = [text, text[:5000] + "zzz" + text[5000:], other]
    terms = similar.trigram_terms(spark.createDataFrame([(v,) for v in values], "v string"), "v")
    found = similar.sparse_cosine_pairs(terms, 0.9).collect()
    assert [{r.id_a, r.id_b} for r in found] == [set(values[:2])]


def test_long_values_with_few_edits(spark):
    text = "abcdefghij" * 1000
    values = [text, text[:5000] + "X" + text[5000:], text[:-1], text[::-1]]
    table = spark.createDataFrame([(v,) for v in values], "value string")
    assert merge.edit_candidates(table, 2).count() == 3
