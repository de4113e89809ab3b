import hashlib
import re

import numpy as np
import pytest
from llm_cases import documents, empty, rows, texts

from tidewash.llm import centroids, fill_middle, lattice

VECTORS = "vec_id long, embedding array<float>, label int, id string, row int, n long, cell string"


def as_table(spark, vectors, ids=None, schema=VECTORS):
    ids = range(len(vectors)) if ids is None else ids
    kept = [(i, v if v is None else [None if x is None else float(x) for x in v]) for i, v in zip(ids, vectors)]
    return spark.createDataFrame([(i, v, 1, "x", 2, 3, "c") for i, v in kept], schema).repartition(3)


# --- Fill-in-the-middle


def by_hand(text, key, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(lines)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in marks):
        return n, "plain", None, None, text
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def lines_texts():
    pick = np.random.default_rng(3)
    found = [
        "".join(pick.choice(["a", "ü", "中", "😀", "\n", "\r\n", " "], int(k)))
        for k in pick.integers(0, 60, 80)
    ]
    found += ["\n", "\n\n", "x", "x\n", "\nx", "a<P>b\nc", "<S>", "l\n" * 5 + "<M>", "<\nP>\n<P\n"]
    return found + ["line 中 " * 3 + "\n" + "ü" * 5000 + "\n" + "\n" * 9000 + "end" * 2000, "no break " * 200_000]


def test_cut_documents_are_those_cut_by_hand(spark):
    cases = list(enumerate([*lines_texts(), *texts()]))
    docs = spark.createDataFrame(cases, "doc_id long, text string").repartition(3)
    found = fill_middle.fill_in_middle(docs).withColumn("back", fill_middle.restored_text())
    got = {r["doc_id"]: tuple(r)[1:] for r in found.collect()}
    for key, text in cases:
        assert got[key] == (*by_hand(text, key), text or ""), key
    assert {v[1] for v in got.values()} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64, 4096])
@pytest.mark.parametrize("unit", fill_middle.UNITS)
def test_every_cut_of_every_block_size(block, unit):
    for text in lines_texts()[:60]:
        index = fill_middle.TextIndex(text.encode(), unit, block)
        units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
        assert index.units == len(units)
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert index.cut(k) == (len(head.encode()), len(head)), (text, k)


@pytest.mark.parametrize("size", [0, 1, 2, 3, 8, 13, 100])
def test_descent_finds_the_block(size):
    pick = np.random.default_rng(size)
    counts = pick.integers(0, 3, (size, 2))
    tree = fill_middle.Fenwick(counts)
    before = np.cumsum(counts, axis=0) - counts
    for wanted in range(1, int(counts[:, 0].sum()) + 1):
        block, sums = tree.descend(0, wanted)
        assert list(sums) == list(before[block])
        assert before[block][0] < wanted <= before[block][0] + counts[block][0]


def test_cutting_odd_tables(spark):
    found = fill_middle.fill_in_middle(documents(spark)).withColumn("back", fill_middle.restored_text())
    got = sorted((r["doc_id"] is None, r["doc_id"], r["back"]) for r in found.collect())
    assert got == sorted((r[0] is None, r[0], r[1] or "") for r in rows())
    assert fill_middle.fill_in_middle(empty(spark)).count() == 0
    odd = documents(spark).withColumnsRenamed({"doc_id": "my.id", "text": "my.text"})
    assert fill_middle.fill_in_middle(odd, "my.id", "my.text").columns[0] == "my.id"
    none = fill_middle.fill_in_middle(documents(spark), cuts=fill_middle.Cuts(rate=0))
    assert {r["form"] for r in none.collect()} == {"plain"}
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(documents(spark), marks=("<P>", "<P>", "<M>"))
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(documents(spark), unit="word")


# --- Clusters around centroids


def plain_clusters(ids, vectors, clusters=8, rounds=10):
    kept = [
        (i, [int(np.floor(1024 * float(np.float32(x)))) for x in v])
        for i, v in zip(ids, vectors)
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)
    ]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in start[:clusters]]

    def nearest(v):
        return min((sum((x - c) ** 2 for x, c in zip(v, center)), k) for k, center in enumerate(centers))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for k, own in groups.items():
            centers[k] = [sum(column) // len(own) for column in zip(*own)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    total = {k: sum(d for _, c, d in found if c == k) for k in range(clusters)}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return [(i, c, d, total[c], sum(total.values()), names[c]) for i, c, d in found]


def odd_vectors():
    pick = np.random.default_rng(5)
    found = [list(v) for v in pick.normal(size=(150, 64)).astype(np.float32)]
    found += [list(v) for v in np.round(pick.normal(size=(50, 64))).astype(np.float32)]
    found += [found[0], found[0], [0.0] * 64, [-0.0] * 64, None, [], [1.0] * 63, [1.0] * 65]
    found += [[float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63]
    return found


def key_of(row):
    return tuple((x is None, x or 0) for x in row)


def test_clusters_are_those_of_plain_rounds(spark):
    vectors = odd_vectors()
    ids = [*range(10, 10 + len(vectors))]
    ids[3] = None
    table = as_table(spark, vectors, ids)
    got = centroids.clustering_digest(centroids.cluster_vectors(table)).collect()
    expected = plain_clusters(ids, vectors)
    assert sorted(map(tuple, got), key=key_of) == sorted(expected, key=key_of)


@pytest.mark.parametrize("seed", range(8))
def test_walk_finds_the_nearest_and_smallest(seed):
    pick = np.random.default_rng(seed)
    count, dimensions = int(pick.integers(1, 30)), int(pick.integers(1, 12))
    spread = int(pick.choice([2, 50, 1000]))
    centers = pick.integers(-spread, spread + 1, (count, dimensions))
    vectors = np.concatenate([pick.integers(-spread, spread + 1, (300, dimensions)), centers])
    lists = centroids.SortedCentroids(centers)
    numbers, distances = lists.nearest(vectors)
    every = ((vectors[:, None] - centers[None]) ** 2).sum(axis=2)
    assert (numbers == every.argmin(axis=1)).all() and (distances == every.min(axis=1)).all()


def test_walk_stops_before_it_has_seen_all():
    pick = np.random.default_rng(1)
    centers = pick.integers(-1000, 1000, (200, 3))
    lists = centroids.SortedCentroids(centers)
    lists.nearest(centers[:100] + pick.integers(-2, 3, (100, 3)))
    assert lists.computed < 100 * 200 / 4


def test_clusters_of_few_none_and_large(spark):
    few = as_table(spark, odd_vectors()[:3])
    assert {r["cluster"] for r in centroids.clustering_digest(centroids.cluster_vectors(few)).collect()} == {0, 1, 2}
    for none in (as_table(spark, []), as_table(spark, [None, [1.0]])):
        found = centroids.clustering_digest(centroids.cluster_vectors(none))
        assert found.count() == 0 and found.columns[0] == "vec_id"
    same = as_table(spark, [[1.0] * 64] * 20)
    assert {r["cluster"] for r in centroids.cluster_vectors(same).assigned.collect()} == {0}
    doubles = as_table(spark, odd_vectors()[:20], schema=VECTORS.replace("float", "double"))
    renamed = doubles.withColumnsRenamed({"vec_id": "my.id", "embedding": "my.vector"})
    assert centroids.cluster_vectors(renamed, "my.id", "my.vector").assigned.count() == 20
    with pytest.raises(Exception, match="fits a long"):
        centroids.cluster_vectors(as_table(spark, [[3e8] * 64]))


# --- Near vectors by lattice hashing


def plain_links(ids, vectors, least=0.95):
    def good(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    count, near = len(vectors), {i: [] for i in range(len(vectors))}
    for size in {len(v) for v in vectors if good(v)}:
        places = [i for i, v in enumerate(vectors) if good(v) and len(v) == size]
        units = lattice.unit(np.array([vectors[i] for i in places], np.float64))
        for a, b in np.argwhere(units @ units.T >= least):
            if a != b:
                near[places[a]].append(places[b])
    label = list(range(count))
    for i in range(count):
        reached, todo = {i}, [i]
        while todo:
            for other in near[todo.pop()]:
                if other not in reached:
                    reached.add(other)
                    todo.append(other)
        label[i] = min((ids[j] for j in reached if ids[j] is not None), default=None)
    return [(ids[i], len(near[i]), label[i], ids[i] == label[i]) for i in range(count)]


def around(center, count, cosine, pick):
    """Vectors whose pairwise cosines are about ``cosine``."""
    noise = pick.normal(size=(count, len(center)))
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    own = center / np.linalg.norm(center)
    return (np.sqrt(cosine) * own + np.sqrt(1 - cosine) * noise).astype(np.float32)


@pytest.fixture(scope="module")
def planted():
    pick = np.random.default_rng(11)
    centers = pick.normal(size=(60, 64))
    found = [*pick.normal(size=(400, 64)).astype(np.float32)]
    for k, center in enumerate(centers):
        found += [*around(center, 2 + k % 5, (0.97, 0.985, 0.995, 0.999)[k % 4], pick)]
    found += [*around(pick.normal(size=64), 300, 0.995, pick)]  # a crowd
    found += [found[0]] * 40 + [found[1] * 3, found[1] * np.float32(0.5)]
    return [list(map(float, v)) for v in found]


def test_links_and_components_against_brute_force(spark, planted):
    vectors = planted + [v[:32] for v in planted[400:420]] + odd_vectors()[-9:]
    ids = list(np.random.default_rng(1).permutation(5 * len(vectors))[: len(vectors)].tolist())
    got = {r["vec_id"]: tuple(r) for r in lattice.near_vectors(as_table(spark, vectors, ids), tile=64).collect()}
    expected = plain_links(ids, vectors)
    assert len(got) == len(expected)
    links, wanted = sum(g[1] for g in got.values()), sum(e[1] for e in expected)
    assert 0.97 * wanted <= links <= wanted
    assert all(got[e[0]][1] <= e[1] for e in expected)  # no link that is none
    same = sum(got[e[0]] == e for e in expected)
    assert same >= 0.97 * len(expected)


def test_tiles_of_any_size_give_the_same(spark, planted):
    table = as_table(spark, planted)
    results = [
        sorted(map(tuple, lattice.near_vectors(table, tile=tile).collect())) for tile in (16, 1024)
    ]
    assert results[0] == results[1]


def test_any_number_of_passes_gives_the_same(spark, planted):
    table, two = as_table(spark, planted + odd_vectors()[-9:]), lattice.Lattice(tables=2)
    results = [
        sorted(map(tuple, lattice.near_vectors(table, lattice=two, pass_rows=rows).collect()), key=key_of)
        for rows in (lattice.PASS_ROWS, 9000, 3000)
    ]
    assert results[0] == results[1] == results[2]


def test_a_crowd_whose_later_pairs_bring_no_new_rows(spark):
    pick = np.random.default_rng(12)
    vectors = [list(map(float, v)) for v in around(pick.normal(size=64), 1600, 0.999999, pick)]
    few = lattice.Lattice(tables=1, probes=2)
    got = lattice.near_vectors(as_table(spark, vectors), lattice=few).collect()
    assert {tuple(r)[1:3] for r in got} == {(1599, 0)} and len(got) == 1600


@pytest.mark.parametrize("kinds", [2, 20, 10**9])
def test_smallest_values_come_in_the_order_of_a_stable_sort(kinds):
    values = np.random.default_rng(kinds).integers(0, kinds, (200, 30)).astype(float)
    order = np.argsort(values, axis=1, kind="stable")
    for count in (0, 1, 8, 29, 30, 31):
        assert (lattice._smallest(values, count) == order[:, :count]).all()
    assert lattice._smallest(values[:0], 8).shape == (0, 8)


def test_cells_of_no_vectors():
    assert lattice.cells(np.empty((0, 64)), lattice.Lattice()).shape == (0, 4, 9)


def test_recall_of_pairs_at_the_bound():
    pick = np.random.default_rng(2)
    a = lattice.unit(pick.normal(size=(4000, 64)))
    side = pick.normal(size=a.shape)
    side = lattice.unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    for cosine, least in ((0.95, 0.92), (0.97, 0.985), (0.99, 0.9995)):
        b = cosine * a + np.sqrt(1 - cosine**2) * side
        cells = [lattice.cells(x, lattice.Lattice()) for x in (a, b)]
        assert (lattice.meeting(*cells) != 0).mean() >= least
    strangers = lattice.cells(np.roll(a, 1, axis=0), lattice.Lattice())
    assert (lattice.meeting(lattice.cells(a, lattice.Lattice()), strangers) != 0).mean() < 0.002


def test_cells_do_not_depend_on_the_batch():
    units = lattice.unit(np.random.default_rng(4).normal(size=(500, 64)))
    whole = lattice.cells(units, lattice.Lattice())
    for size in (1, 7, 100):
        parts = [lattice.cells(units[k : k + size], lattice.Lattice()) for k in range(0, 500, size)]
        assert (np.concatenate(parts) == whole).all()


def test_decoding_gives_the_nearest_lattice_point():
    pick = np.random.default_rng(6)
    y = pick.normal(size=(300, 8)) * 2
    point = lattice.decode(y)
    doubled = np.rint(2 * point)
    assert (doubled == 2 * point).all()
    assert ((doubled % 2 == 0).all(axis=1) | (doubled % 2 == 1).all(axis=1)).all()
    assert (point.sum(axis=1) % 2 == 0).all()
    own = ((y - point) ** 2).sum(axis=1)
    assert (own <= 1 + 1e-9).all()  # the covering radius
    others = point[:, None] + lattice.shortest_vectors()[None]
    assert (((y[:, None] - others) ** 2).sum(axis=2) >= own[:, None] - 1e-9).all()
    assert len({tuple(v) for v in lattice.shortest_vectors()}) == 240


def test_connecting_within_a_tile():
    pick = np.random.default_rng(7)
    for _ in range(30):
        a, b = pick.integers(0, 60, (2, 45))
        label = lattice.hubs(60, a, b)
        plain = list(range(60))
        for _ in range(60):
            for x, y in zip(a, b):
                plain[x] = plain[y] = min(plain[x], plain[y])
        assert label.tolist() == plain


def test_near_vectors_of_odd_tables(spark):
    assert lattice.near_vectors(as_table(spark, [])).count() == 0
    vectors = [None, [], [0.0] * 4, [1e-45, 0, 0, 0], [1, 0, 0, 0], [1, 0, 0, 0], [3e38, 1e30, 0, 0], [float("nan")] * 4]
    ids = [7, 7, None, None, 5, 5, 4, 3]
    got = sorted(map(tuple, lattice.near_vectors(as_table(spark, vectors, ids)).collect()), key=key_of)
    expected = [(i, n, c, k) for i, n, c, k in [
        (7, 0, 7, True), (7, 0, 7, True), (None, 0, None, True), (None, 3, 4, False),
        (5, 3, 4, False), (5, 3, 4, False), (4, 3, 4, True), (3, 0, 3, True)]]
    assert got == sorted(expected, key=key_of)
    wide = as_table(spark, [[1e300, 1.0], [1e-300, 0.0], [1.0, 1.0]], schema=VECTORS.replace("float", "double"))
    renamed = wide.withColumnsRenamed({"vec_id": "my.id", "embedding": "my.vector"})
    assert [r["n_links"] for r in lattice.near_vectors(renamed, "my.id", "my.vector").orderBy("`my.id`").collect()] == [1, 1, 0]
    with pytest.raises(ValueError):
        lattice.Lattice(probes=81)
