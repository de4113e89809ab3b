"""Cross-entropy difference of two matched n-gram models.

A target model and a background model are counted over the whole corpus, with
one vocabulary and one smoothing for both, and every document is scored by the
mean difference of its tokens' losses.

:func:`score_corpus` counts every word, context and pair apart (by 62 bits of their
hashes), so the models grow with the corpus. Documents are put into blocks that are
written once. A block asks for the counts of its distinct words, contexts and pairs by
ranges of the hash; each range sums what all blocks have and answers every block. A
key comes once from a block, however often it occurs, so a common word or pair is no
larger than any other. Blocks and ranges have a fixed size; the input decides how many
there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewash.functions.scratch import write_scratch
from tidewash.llm.decontaminate import _PLAIN
from tidewash.llm.registry import query, table
from tidewash.llm.words import cut_words, mix, text_blocks

#: Words and documents in one block, about.
BLOCK_WORDS = 1 << 20
#: Words of the corpus for each range of the keys.
RANGE_WORDS = 1 << 20
#: Weight of the shorter context: as many observations of it are added to each context.
PRIOR = 50.0


def _packed(values: np.ndarray) -> bytes:
    """Eight-byte numbers, compressed with the bytes of equal place together."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _unpacked(packed: bytes, count: int, kind: str = "<i8") -> np.ndarray:
    if not count:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(packed, 8 * count, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).reshape(-1).view(kind)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Documents by the block: ids, token counts, distinct words and each token's word."""
    first = TaskContext.get().partitionId() << 33
    number, total = 0, 0
    ids, sizes, hashes = [], [], []

    def done() -> pa.RecordBatch:
        words, tokens, counts = np.unique(
            np.concatenate(hashes), return_inverse=True, return_counts=True
        )
        common = np.argsort(-counts, kind="stable")  # small numbers take less space
        rank = np.empty(len(words), np.int64)
        rank[common] = np.arange(len(words))
        one = lambda values: pa.ListArray.from_arrays(
            pa.array([0, len(values)], pa.int32()), values
        )
        return pa.RecordBatch.from_arrays(
            [
                pa.array([first + number], pa.int64()),
                one(pa.concat_arrays(ids)),
                one(pa.array(np.concatenate(sizes).astype(np.int64))),
                one(pa.array(words[common].view(np.int64))),
                pa.array([_packed(rank[tokens])], pa.binary()),
            ],
            names=["block", "ids", "sizes", "words", "tokens"],
        )

    for batch, raw in text_blocks(batches):
        words = cut_words([t.translate(_PLAIN) for t in raw])
        ids.append(batch.column("id"))
        sizes.append(np.diff(words.first))
        hashes.append(words.hashes())
        total += len(raw) + len(words.starts)
        if total >= size:
            yield done()
            number, total = number + 1, 0
            ids, sizes, hashes = [], [], []
    if ids:
        yield done()


_START = mix(np.array([99], np.uint64))
_KIND = np.uint64(3)


@dataclass(frozen=True)
class Block:
    """The sorted keys of a block's words, contexts and pairs (told apart by the last
    two bits), and the places of every token's word, context and pair among them."""

    keys: np.ndarray
    places: tuple[np.ndarray, np.ndarray, np.ndarray]
    owner: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(row: pa.Table) -> Block:
        sizes = row["sizes"].combine_chunks().flatten().to_numpy()
        words = row["words"].combine_chunks().flatten().to_numpy()
        tokens = _unpacked(row["tokens"][0].as_py(), int(sizes.sum()))
        # The number 0 is the start of a document.
        names = np.concatenate((_START, words.view(np.uint64)))
        own, before = tokens + 1, np.zeros_like(tokens)
        before[1:] = own[:-1]
        before[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
        codes, pair = np.unique(before * len(names) + own, return_inverse=True)
        pairs = mix(mix(names[codes // len(names)]) + names[codes % len(names)])
        keys = np.concatenate([(h & ~_KIND) | np.uint64(k) for k, h in enumerate((names, names, pairs))])
        order = np.argsort(keys)
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        places = (rank[own], rank[before + len(names)], rank[pair + 2 * len(names)])
        return Block(keys[order], places, np.repeat(np.arange(len(sizes)), sizes), sizes)


def _ask(row: pa.Table, marks: pa.Table, ranges: int) -> pa.Table:
    """What the block has of each of its keys, by range of the keys."""
    block = Block.of(row)
    target = np.zeros(len(block.sizes), bool)
    target[marks["place"].to_numpy()] = True
    chosen = target[block.owner]
    counts = [
        sum(np.bincount(p, minlength=len(block.keys)) for p in places)
        for places in (block.places, [p[chosen] for p in block.places])
    ]
    range_of = ((block.keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    used, starts = np.unique(range_of, return_index=True)
    cuts = list(zip(starts, [*starts[1:], len(block.keys)], strict=True))
    steps = [np.diff(block.keys[a:b], prepend=np.uint64(0)) for a, b in cuts]
    return pa.table(
        {
            "range": pa.array(used.astype(np.int32)),
            "block": pa.array([row["block"][0].as_py()] * len(used), pa.int64()),
            "n": pa.array([b - a for a, b in cuts], pa.int64()),
            "keys": pa.array([_packed(s) for s in steps], pa.binary()),
            "background": pa.array([_packed(counts[0][a:b]) for a, b in cuts], pa.binary()),
            "target": pa.array([_packed(counts[1][a:b]) for a, b in cuts], pa.binary()),
        }
    )


def _answer(asked: pa.Table) -> pa.Table:
    """For every block the sums over all blocks, in the order of its keys."""
    sizes = asked["n"].to_pylist()
    cuts = np.cumsum(sizes)[:-1]

    def column(name: str, kind: str = "<i8") -> list[np.ndarray]:
        packed = asked[name].to_pylist()
        return [_unpacked(p, n, kind) for p, n in zip(packed, sizes, strict=True)]

    keys = np.concatenate([np.cumsum(s, dtype=np.uint64) for s in column("keys", "<u8")])
    unique, place = np.unique(keys, return_inverse=True)
    found = {"block": asked["block"], "range": asked["range"], "n": asked["n"]}
    for name in ("background", "target"):
        sums = np.bincount(place, np.concatenate(column(name)), minlength=len(unique))
        parts = np.split(sums.astype(np.int64)[place], cuts)
        found[name] = pa.array([_packed(p) for p in parts], pa.binary())
    return pa.table(found)


def _score_block(
    row: pa.Table, answers: pa.Table, totals: dict[str, int], vocabulary: int
) -> pa.Table:
    block = Block.of(row)
    answers = answers.sort_by("range")
    sizes = answers["n"].to_pylist()
    own, before, pair = block.places
    means = {}
    for name, total in totals.items():
        packed = answers[name].to_pylist()
        counts = np.concatenate([_unpacked(p, n) for p, n in zip(packed, sizes, strict=True)])
        alone = (counts[own] + 1.0) / (total + vocabulary)
        losses = -np.log((counts[pair] + PRIOR * alone) / (counts[before] + PRIOR))
        sums = np.bincount(block.owner, losses, minlength=len(block.sizes))
        means[name] = sums / np.maximum(block.sizes, 1)
    return pa.table(
        {
            "id": row["ids"].combine_chunks().flatten(),
            "n_tokens": pa.array(block.sizes),
            "target_loss": pa.array(means["target"]),
            "background_loss": pa.array(means["background"]),
            "score": pa.array(means["background"] - means["target"]),
        }
    )


def score_corpus(
    docs: DataFrame,
    target: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    block_words: int = BLOCK_WORDS,
    range_words: int = RANGE_WORDS,
) -> DataFrame:
    """``id, n_tokens, target_loss, background_loss, score`` for every row.

    The background is all of ``docs``, the target its rows with an id of ``target``.
    Every word and pair has a count of its own, and the smoothing is shared by as
    many words as the corpus has. Losses are means per token in nats; ``score`` is the
    background's less the target's, so higher is closer to the target.

    Defined results: a text without words (null, empty, blank) has no tokens and
    zeros; with no target documents the target model knows the smoothing alone; an
    empty table gives an empty result. Other columns are not looked at.
    """
    kind = docs.schema[id].dataType.simpleString()
    blocks = write_scratch(
        docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(
            lambda b: _blocks(b, block_words),
            f"block long, ids array<{kind}>, sizes array<long>, words array<long>, tokens binary",
        ),
        "blocks",
        "zstd",
    )
    vocabulary = blocks.select(F.explode("words")).distinct().count()
    # Labels grow with the documents, so the join is by sorting at every size.
    marks = write_scratch(
        blocks.select("block", F.posexplode(F.arrays_zip("ids", "sizes")).alias("place", "doc"))
        .select("block", "place", F.col("doc.sizes").alias("size"), F.col("doc.ids").alias("id"))
        .join(target.select(F.col(f"`{id}`").alias("id")).distinct().hint("merge"), "id")
        .select("block", "place", "size"),
        "marks",
    )
    words = blocks.select(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))
    totals = {
        "target": marks.agg(F.sum("size")).first()[0] or 0,
        "background": words.agg(F.sum("n")).first()[0] or 0,
    }
    ranges = 1 + totals["background"] // range_words
    # Asking and scoring group the same rows by block, so Spark shuffles them once.
    answers = (
        blocks.groupBy("block")
        .cogroup(marks.select("block", "place").groupBy("block"))
        .applyInArrow(
            lambda row, marked: _ask(row, marked, ranges),
            "range int, block long, n long, keys binary, background binary, target binary",
        )
        .groupBy("range")
        .applyInArrow(_answer, "block long, range int, n long, background binary, target binary")
    )
    return (
        blocks.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(
            lambda row, found: _score_block(row, found, totals, vocabulary),
            f"id {kind}, n_tokens long, target_loss double, background_loss double, score double",
        )
        .withColumnRenamed("id", id)
    )


@query("op3_lm_cross_entropy")
def op3_lm_cross_entropy(spark: SparkSession, folder: str) -> DataFrame:
    good = table(spark, folder, "labels").where("quality = 1 AND toxic = 0")
    return score_corpus(table(spark, folder, "documents"), good)
