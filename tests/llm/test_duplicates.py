import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
import xxhash
from llm_cases import COLUMNS, documents, empty, rows, sentence
from pyspark.sql import functions as F

from tidewash.llm import exact_dedup, simhash, substring_dedup


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup_by_brute_force(spark):
    groups = {}
    for r in rows():
        groups.setdefault(normal(r[1]), []).append(r[0])
    expected = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        for i in ids:
            expected[(i, keep, len(ids), digest)] += 1
    found = exact_dedup.exact_dedup(documents(spark)).collect()
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found)
    assert got == expected
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_exact_dedup_of_a_group_over_many_buckets(spark):
    hot = spark.range(3000).selectExpr(
        "id AS doc_id", "IF(id % 3 = 0, 'the  same text', concat('text ', id % 700)) AS text"
    )
    found = exact_dedup.exact_dedup(hot.repartition(5))
    sizes = found.where("doc_id % 3 = 0").agg(
        F.min("group_size"), F.max("group_size"), F.max("keep_id"), F.sum(F.col("kept").cast("int"))
    )
    assert tuple(sizes.first()) == (1000, 1000, 0, 1)
    kept = exact_dedup.keep_first(hot)
    texts = {normal(r.text) for r in hot.collect()}
    assert Counter(normal(r.text) for r in kept.collect()) == Counter(texts)


def test_keep_first_keeps_whole_rows(spark):
    docs = documents(spark)
    kept = exact_dedup.keep_first(docs)
    assert kept.schema == docs.schema
    groups = {}
    for r in rows():
        best = groups.get(normal(r[1]))
        if best is None or (r[0] is None, r[0]) < (best is None, best):
            groups[normal(r[1])] = r[0]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(groups.values())


@pytest.mark.parametrize("keep", [exact_dedup.keep_first, simhash.keep_one_of_near])
def test_keeping_nothing(spark, keep):
    assert keep(empty(spark)).count() == 0


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def fingerprint(text):
    words = re.findall(
        rb"[^\x20\x09-\x0D]+",
        re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()),
    )
    cuts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    cuts = cuts or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(c, 42) for c in cuts]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def near_groups(prints, distance):
    name = {p: p for p in prints}

    def find(p):
        while name[p] != p:
            p = name[p]
        return p

    every = list(prints)
    for i, a in enumerate(every):
        for b in every[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance:
                name[find(a)] = find(b)
    return {p: find(p) for p in every}


def near_rows():
    found = [(r[0], r[1]) for r in rows()]
    base = sentence(50, 400).split()
    pick = random.Random(3)
    for k in range(60):  # slightly edited copies: fingerprints a few bits apart
        words = list(base)
        words[pick.randrange(400)] = f"edit{k}"
        found.append((1000 + k, " ".join(words)))
    return found


def test_near_duplicates_by_brute_force(spark):
    given = near_rows()
    prints = [fingerprint(t) for _, t in given]
    groups = near_groups(set(prints), 2)
    smallest = {}
    for (i, _), p in zip(given, prints, strict=True):
        if i is not None:
            g = groups[p]
            smallest[g] = min(i, smallest.get(g, i))
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    got = Counter(tuple(r) for r in simhash.near_duplicates(docs).collect())
    assert got == Counter(
        (i, p, smallest.get(groups[p])) for (i, _), p in zip(given, prints, strict=True)
    )
    assert len(set(groups.values())) < len(groups)


@pytest.mark.parametrize(("distance", "pairs"), [(2, 32), (2, 1), (1, 32), (3, 32), (0, 32)])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, distance, pairs):
    monkeypatch.setattr(simhash, "CELL_PAIRS", pairs)
    pick = random.Random(distance)
    prints = set()
    for _ in range(25):
        centre = pick.getrandbits(64)
        for _ in range(12):
            value = centre
            for _ in range(pick.randrange(4)):
                value ^= 1 << pick.randrange(64)
            prints.add(value - (1 << 64) if value >> 63 else value)
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    links = simhash.fingerprint_links(frame, distance).collect()
    for a, b in links:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= distance
    expected = near_groups(prints, distance)
    name = {p: p for p in prints}

    def find(p):
        while name[p] != p:
            p = name[p]
        return p

    for a, b in links:
        name[find(a)] = find(b)
    sizes = Counter(Counter(expected.values()).values())
    assert Counter(Counter(find(p) for p in prints).values()) == sizes


def test_segment_counts_bound_the_hamming_distance(spark):
    pick = random.Random(8)
    values = [pick.getrandbits(64) - (1 << 63) for _ in range(200)]
    pairs = spark.createDataFrame(list(zip(values, values[::-1], strict=True)), "a long, b long")
    row = pairs.select(
        simhash.manhattan(simhash.segment_counts(F.col("a")), simhash.segment_counts(F.col("b"))),
        simhash.hamming(F.col("a"), F.col("b")),
        "a",
        "b",
    )
    for lower, exact, a, b in row.collect():
        pieces = [
            abs((a >> s & 3).bit_count() - (b >> s & 3).bit_count()) for s in range(0, 64, 2)
        ]
        assert lower == sum(pieces) <= exact


def test_keep_one_of_near_keeps_the_smallest_ids(spark):
    docs = documents(spark)
    kept = simhash.keep_one_of_near(docs)
    assert kept.schema == docs.schema
    named = simhash.near_duplicates(docs).collect()
    assert Counter(r.doc_id for r in kept.collect()) == Counter({r.component_id for r in named})


def test_near_duplicates_of_nothing(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0


def removed_by_brute_force(given, window):
    first = {}
    for i, text in given:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            known = float("inf") if i is None else i
            first[key] = min(known, first.get(key, known))
    result = Counter()
    for i, text in given:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < (float("inf") if i is None else i):
                gone.update(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        result[(i, len(words), len(gone), kept)] += 1
    return result


@pytest.mark.parametrize(
    "sizes", [{}, {"block_text": 400, "range_text": 700, "part_text": 300}, {"block_text": 1}]
)
def test_substring_dedup_by_brute_force(spark, sizes):
    pick = random.Random(4)
    passages = [sentence(200 + k, 25) for k in range(6)]
    given = [(r[0], r[1]) for r in rows()]
    for i in range(40):
        parts = [sentence(300 + i, pick.randrange(30))]
        for _ in range(pick.randrange(3)):
            words = pick.choice(passages).split()
            cut = pick.randrange(12)
            parts += [" ".join(words[cut:]), sentence(pick.randrange(10**6), pick.randrange(9))]
        given.append((1000 + i, "\n".join(parts)))
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(4)
    result = substring_dedup.substring_dedup(docs, **sizes)
    assert Counter(tuple(r) for r in result.collect()) == removed_by_brute_force(given, 13)


def test_substring_dedup_loses_nothing_with_a_crowded_sketch(spark):
    given = [(r[0], r[1]) for r in rows()]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    result = substring_dedup.substring_dedup(docs, range_cells=8, block_text=2000)
    found = Counter(tuple(r) for r in result.collect())
    assert found == removed_by_brute_force(given, 13)


def test_groups_of_substring_dedup_keep_their_size(spark, monkeypatch):
    def sizes(copies):
        given = [(i, sentence(i, 400)) for i in range(copies)]
        docs = spark.createDataFrame(given, "doc_id long, text string")
        total = sum(len(t) for _, t in given)
        blocks = 1 + total // 20_000
        found = []
        for number in range(blocks):
            own = docs.selectExpr(
                "doc_id AS id", "text", "xxhash64(text) AS text_hash",
                f"CAST(pmod(xxhash64(doc_id, xxhash64(text)), {blocks}) AS INT) AS block",
            ).where(F.col("block") == number).toArrow()
            if own.num_rows:
                found.append(substring_dedup._count_anchors(own, 1 + total // 30_000, 13, 5))
        counted = pa.concat_tables(found).to_pandas()
        return counted.groupby("range")["n"].sum()

    small, large = sizes(60), sizes(600)
    assert len(large) > 8 * len(small) / 1.3
    assert large.max() < 1.5 * small.max()  # ten times the texts, ranges of the same size


def test_substring_dedup_with_a_text_longer_than_a_block(spark):
    long = sentence(1, 30_000)
    words = long.split()
    given = [(1, long), (2, " ".join(words[100:160])), (3, long), (4, "other " * 20)]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    result = substring_dedup.substring_dedup(docs, block_text=50_000)
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in result.collect()}
    assert found == {
        1: (30_000, 0, long), 2: (60, 60, ""), 3: (30_000, 30_000, ""), 4: (20, 0, ("other " * 20).strip()),
    }


def test_substring_dedup_with_clashing_columns_and_nothing(spark):
    given = [(r[0], r[1]) for r in rows()]
    found = substring_dedup.substring_dedup(documents(spark))
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_text"]
    assert Counter(tuple(r) for r in found.collect()) == removed_by_brute_force(given, 13)
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0
    assert COLUMNS.count("long") == 2
