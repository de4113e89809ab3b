import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_cases import documents, empty, rows
from tokenizers import Tokenizer

from tidewash.llm import packing, token_files
from tidewash.llm.tokens import CachedEncoder, tokenizer_path

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def one_by_one(lengths, capacity):
    left = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(left) if room >= length]
        if not fits:
            left.append(capacity)
            fits = [len(left) - 1]
        left[min(fits, key=left.__getitem__)] -= length
    return sorted(left)


def places(counts, capacity):
    slots, opened = packing.best_fit(counts, capacity)
    found = {}
    for length, count in counts.items():
        own = sorted((s for s in slots if s.length == length), key=lambda s: s.rank)
        for rank in range(count):
            slot = [s for s in own if s.rank <= rank][-1]
            k = rank - slot.rank
            found.setdefault(slot.sequence + k // slot.each, []).append(
                (slot.offset + k % slot.each * length, length)
            )
    assert len(found) == opened
    return found


def left_over(sequences, capacity):
    rest = []
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        rest.append(capacity - at)
    return sorted(rest)


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_that_of_placing_one_by_one(seed):
    pick = random.Random(seed)
    capacity = pick.choice([3, 10, 64, 1024])
    odd = [capacity, 1, capacity // 2 + 1, max(1, capacity // 3)]
    lengths = [
        pick.choice(odd) if pick.random() < 0.3 else pick.randint(1, capacity)
        for _ in range(pick.choice([0, 1, 40, 300]))
    ]
    sequences = places(Counter(lengths), capacity)
    assert left_over(sequences, capacity) == one_by_one(lengths, capacity)


def test_plan_does_not_grow_with_the_number_of_pieces():
    small, _ = packing.best_fit({n: 50 for n in range(1, 1025)}, 1024)
    large, _ = packing.best_fit({n: 50_000_000 for n in range(1, 1025)}, 1024)
    assert len(large) < 2 * len(small) + 2000


@pytest.mark.parametrize("file", FILES)
def test_cached_ids_are_those_of_whole_texts(file):
    encoder = CachedEncoder(tokenizer_path(file), cached=50)
    texts = [r[1] or "" for r in rows()]
    texts += ["it's I'M 12 3,4 ...!!\r\n\r\n end ", "\n", " ", "a\n\n b", "x's'sabc a.b. ''t", "😀 a"]
    texts += ["a  b", " a", "a ", "a \n b", "a\n b", "a \nb", "a\t b c", "  a", "a\n  b ", " \n", "x, y.\nZ"]
    texts += ["the, (the) \"the\" the%%% the%%%x %%% é́ á,b |", "naïve café, Straße! ÀÉ."]
    texts += ["a .", "a  .", ". a.", "a a. a., a.b. a'. 'a. a1. a1 a_.", "à à. à à.; a\na. a\n."]
    plain = Tokenizer.from_file(tokenizer_path(file))
    for _ in range(2):  # the second time from the cache
        for text, got in zip(texts, encoder.encode(texts), strict=True):
            ids = plain.encode(text, add_special_tokens=False).ids
            assert got == np.array(ids, "<u4").tobytes(), text


def whole_ids(file, end):
    plain = Tokenizer.from_file(tokenizer_path(file))
    return [
        (r[0], [*plain.encode(r[1] or "", add_special_tokens=False).ids, end]) for r in rows()
    ]


def test_pieces_put_together_are_the_documents(spark):
    packed = packing.pack_documents(documents(spark), tokenizer_path(FILES[0]), max_tokens=64)
    found = packed.collect()
    assert packed.columns[0] == "doc_id"
    expected = Counter((d, tuple(ids)) for d, ids in whole_ids(FILES[0], 2))
    pieces = Counter()
    for doc, ids in expected:
        first = len(ids) % 64 or min(64, len(ids))
        cuts = [0, *range(first, len(ids) + 1, 64)]
        for number, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            key = (doc, number, a, b - a, np.array(ids[a:b], "<u4").tobytes())
            pieces[key] += expected[(doc, ids)]
    assert Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in found) == pieces
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    lengths = [r.length for r in found]
    assert left_over(sequences, 64) == one_by_one(lengths, 64)
    whole = {r.sequence_id: bytes(r.ids) for r in packing.packed_sequences(packed).collect()}
    for r in found:
        part = whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)]
        assert part == bytes(r.ids)


def test_packing_nothing(spark):
    assert packing.pack_documents(empty(spark), tokenizer_path(FILES[0])).count() == 0
    assert packing.packed_digests(empty(spark)).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    folder = str(tmp_path / "tokens")
    token_files.write_tokens(documents(spark), folder, tokenizer_path(FILES[1]), files=4)
    found = token_files.read_tokens(spark, folder)
    got = sorted(found.collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d))
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        at += r.n_tokens
    expected = Counter((d, tuple(x)) for d, x in whole_ids(FILES[1], 1))
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == expected
    sums = {r.start: r.ids_crc32 for r in token_files.token_checksums(found).collect()}
    for r in got:
        assert sums[r.start] == zlib.crc32(np.array(r.ids, "<u4").tobytes())


def test_token_files_prune_by_id(spark, tmp_path):
    folder = str(tmp_path / "tokens")
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('word ', id) AS text")
    token_files.write_tokens(docs, folder, tokenizer_path(FILES[1]), files=2)
    assert token_files.read_tokens(spark, folder).where("doc_id = 77").count() == 1
    plan = spark.read.orc(folder).where("doc_id = 77")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,77)" in text


def test_token_files_of_nothing(spark, tmp_path):
    folder = str(tmp_path / "tokens")
    token_files.write_tokens(empty(spark), folder, tokenizer_path(FILES[1]), files=2)
    assert token_files.read_tokens(spark, folder).count() == 0
